"""Where training steps lie in the token stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Geometry:
    """Sequence length in tokens and batch size in sequences."""

    sequence_length: int
    batch_sequences: int

    def __post_init__(self):
        if self.sequence_length <= 0 or self.batch_sequences <= 0:
            raise ValueError("sequence_length and batch_sequences must be positive")

    @property
    def step_tokens(self) -> int:
        return self.sequence_length * self.batch_sequences

    def token_range(self, step: int, steps: int) -> tuple[int, int]:
        """Half-open token range of ``steps`` steps from ``step`` on."""
        return step * self.step_tokens, (step + steps) * self.step_tokens

    def token_range_columns(self, step: Column, steps: Column) -> tuple[Column, Column]:
        """The same range for step columns."""
        per_step = F.lit(self.step_tokens).cast("bigint")
        first = step.cast("bigint")
        return first * per_step, (first + steps.cast("bigint")) * per_step

    def check_range(self, start: int, end_excl: int, align: str | None = None) -> tuple[int, int]:
        """Validate a placement range; ``align='inward'`` shrinks it to whole sequences."""
        length = self.sequence_length
        if align == "inward":
            start, end_excl = -(-start // length) * length, end_excl // length * length
        elif align is not None:
            raise ValueError(f"unknown align: {align!r}")
        for name, value in (("start", start), ("end", end_excl)):
            if value % length:
                raise ValueError(f"{name} {value} is not a multiple of the sequence length {length}")
        if end_excl - start < length:
            raise ValueError(f"no whole sequence between {start} and {end_excl}")
        return start, end_excl
