import hashlib
from collections import defaultdict

from tallywatch.llm.linededup import LineRuns, drop_lines, op6_line_dedup, without_repeated_lines
from tests.llm.cases import awkward, awkward_rows, empty, lower, small, texts, written

BLANK = " \t\n\x0b\f\r"


def brute(docs):
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[lower(line.strip(BLANK))].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = lower(line.strip(BLANK))
            least = min(holders[key], key=lambda x: (x is None, x or 0))
            if len(key) < 10 or least == i:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_the_small_table(spark, folder):
    assert rows(op6_line_dedup(spark, folder)) == brute(texts(small(spark)))


def test_awkward_rows(spark, tmp_path):
    found = rows(op6_line_dedup(spark, written(spark, awkward(spark), tmp_path)))
    assert found == brute([(r[0], r[1]) for r in awkward_rows()])
    assert sum(r[2] for r in found) > 0


def test_any_number_of_batches_gives_the_same(spark):
    docs = small(spark).select("doc_id", "text")
    results = [
        rows(drop_lines(docs, batches).select("whole.c0", "kept", "n_lines", "n_dropped")) for batches in (1, 7)
    ]
    assert results[0] == results[1]


def test_runs_are_compacted_by_level(spark):
    state = LineRuns(spark, buckets=4, fan_in=2)
    for i in range(5):
        state.add(spark.range(i * 10, i * 10 + 10).selectExpr("id as h1", "id as h2"))
    assert [len(level) for level in state.levels] == [1, 0, 1]
    probe = spark.range(60).selectExpr("id as h1", "id as h2")
    assert sorted(r["h1"] for r in state.unseen(probe).collect()) == list(range(50, 60))


def test_documents_keep_their_columns(spark):
    docs = awkward(spark)
    kept = without_repeated_lines(docs)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_empty_table(spark, tmp_path):
    assert op6_line_dedup(spark, written(spark, empty(spark), tmp_path)).collect() == []
