"""Every stage of the pipeline against plain versions, on its own input."""

import corpus_pipeline
from inlay.llm import op5_decontamination
from tests.llm.corpus import documents, line_removals, near_components, words
from tests.llm.test_decontamination import brute_tiles
from tests.llm.test_packing import check, rows_of

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def inputs(spark, folder):
    docs = [(d, t, "en", s, len(t or "")) for d, t, s, *_ in documents(4)]
    docs += [(700 + i, f"the end of line {i} is here and " + " ".join(f"of w{i}x{k} the" for k in range(40)), "en", "s", 1) for i in range(12)]
    items = [(1, "a benchmark passage that " + " ".join(f"q{k}" for k in range(20))), (2, None)]
    leak = " ".join(f"of y{k} the" for k in range(40)) + " " + items[0][1]
    docs += [(800, leak, "en", "s", 1)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages(spark, tmp_path):
    items = inputs(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        out = spark.read.parquet(f"{tmp_path}/out{k}")
        after = [tuple(r) for r in out.collect()]
        if name != "packing":
            assert out.columns == columns
        texts = {r[0]: r[1] for r in before}
        if name == "quality_rules":
            assert 12 <= len(after) < len(before) and set(after) <= set(before)
        elif name == "line_dedup":
            gone = line_removals(before)
            left = {d: "\n".join(p for n, p in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in texts.items()}
            want = {d: t for d, t in left.items() if words(t) or t == texts[d]}
            assert {r[0]: r[1] for r in after} == want
        elif name == "near_dedup":
            groups = near_components(before, 5)
            assert sorted(r[0] for r in after) == sorted(r[0] for r in before if groups[r[0]][1] == r[0])
        elif name == "decontamination":
            bad = {
                d for d, t in texts.items() for _, item in items
                if item and brute_tiles(words(t), words(item), 5) >= op5_decontamination.THRESHOLD * len(words(item))
            }
            assert bad == {800} and sorted(r[0] for r in after) == sorted(d for d in texts if d not in bad)
        else:
            check(out.collect(), rows_of(before), 1024)
        docs = out
    pieces = {(r.doc_id, r.piece) for r in docs.collect()}
    assert {(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == pieces
