import hashlib
import re
from collections import Counter

import pytest

from tallywatch.llm import fim
from tests.compare import connect, differences
from tests.llm.cases import awkward, awkward_rows, empty, small, texts, written

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, rate=50, spm=80, seed=42):
    """Units one by one, and the contract's words."""
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"{seed}:{'null' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def wanted(docs):
    rows = [(*e[:5], sha(e[5]), sha(t or "")) for i, t in docs for e in [expected(i, t)]]
    return Counter(rows)


def test_query_on_the_small_table(spark, folder):
    found = Counter(map(tuple, fim.op11_fill_in_middle(spark, folder).collect()))
    assert found == wanted(texts(small(spark)))
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert differences(fim.op11_fill_in_middle(spark, folder), connect(folder), fim.OP11_SQL) == []


def test_awkward_rows(spark, tmp_path):
    found = fim.op11_fill_in_middle(spark, written(spark, awkward(spark), tmp_path)).collect()
    assert Counter(map(tuple, found)) == wanted([r[:2] for r in awkward_rows()])


def test_empty_table(spark, tmp_path):
    assert fim.op11_fill_in_middle(spark, written(spark, empty(spark), tmp_path)).collect() == []


def test_sentinels_and_their_pieces_survive(spark):
    pieces = ["<", "<S", "<P", "S>", "M><", "<<", " <", "a<S >", "é<", "<M\n", ">", "x"]
    rows = [(i, "".join(pieces[(i * k + k * k) % len(pieces)] + " " * (k % 2) for k in range(1, 9))) for i in range(300)]
    rows += [(1000 + i, f"one {mark} two") for i, mark in enumerate(("<P>", "<S>", "<M>"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = {r["doc_id"]: r for r in fim.restore(fim.transform(docs, rate=100)).collect()}
    for i, text in rows:
        form = expected(i, text, rate=100)[2]
        assert (made[i]["text"], made[i]["form"], made[i]["output"]) == (text, form, expected(i, text, rate=100)[5])
    assert all(made[1000 + i]["form"] == "plain" for i in range(3))


def test_rates_and_seed_are_parameters(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('a b c ', id, ' d e ') as text")
    forms = lambda **k: Counter(r["form"] for r in fim.transform(docs, **k).collect())
    assert forms(rate=0) == {"plain": 400} and forms(rate=100, spm=0) == {"psm": 400}
    assert fim.transform(docs).collect() != fim.transform(docs, seed=1).collect()
    assert forms() == forms()
    with pytest.raises(ValueError):
        fim.transform(docs, rate=101)


def test_a_very_long_text_and_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 7L AS doc_id, repeat('ab \\n', 500000) AS text UNION ALL SELECT 8L, cast(X'61ff2062' AS string)")
    rows = {r["doc_id"]: r for r in fim.restore(fim.transform(docs, rate=100)).selectExpr("doc_id", "n", "cast(text AS binary) AS text").collect()}
    assert rows[7]["n"] == 500_001 and bytes(rows[7]["text"]) == b"ab \n" * 500_000
    assert rows[8]["n"] == 2 and bytes(rows[8]["text"]) == b"a\xff b"
