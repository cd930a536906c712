from collections import Counter, defaultdict

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallywatch.llm.mixing import water_level
from tests.llm import test_fertility, test_linededup, test_simhash
from tests.llm.cases import awkward, empty, lower, small, texts, words, written
from tests.llm.test_mixing import near


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before the first stage and after each, written as Parquet and read again."""
    top = tmp_path_factory.mktemp("pipeline")
    docs = small(spark)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(top / str(k)))
        docs = spark.read.parquet(str(top / str(k)))
        out.append(docs)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_stage_but_the_last_returns_documents(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(s.schema.names == steps[0].schema.names and s.dtypes == steps[0].dtypes for s in steps[:-1])


def test_quality_rules_take_whole_documents(steps):
    before, after = Counter(rows(steps[0])), Counter(rows(steps[1]))
    assert not after - before
    kept = {i for i, _ in texts(steps[1])}
    sound = {i for i, t in texts(steps[0]) if not test_fertility.base(t)[-1]}
    assert kept <= sound and len(kept) >= 0.95 * len(sound)


def test_line_dedup_matches_brute_force(steps):
    holders = defaultdict(set)
    for i, t in texts(steps[1]):
        for line in (t or "").split("\n"):
            holders[lower(line.strip(test_linededup.BLANK))].add(i)

    def kept(i, t):
        keys = [(line, lower(line.strip(test_linededup.BLANK))) for line in (t or "").split("\n")]
        return "\n".join(line for line, key in keys if len(key) < 10 or min(holders[key]) == i)

    assert sorted(texts(steps[2])) == sorted((i, kept(i, t)) for i, t in texts(steps[1]))
    assert sorted(texts(steps[2])) != sorted(texts(steps[1]))


def test_near_dedup_leaves_the_smallest_of_every_group(steps):
    groups = {r[2] for r in test_simhash.brute(texts(steps[2]))}
    assert sorted(i for i, _ in texts(steps[3])) == sorted(groups) and len(groups) < steps[2].count()
    assert not Counter(rows(steps[3])) - Counter(rows(steps[2]))


def test_mixing_comes_near_its_targets(steps):
    sizes, rows_of = Counter(), defaultdict(list)
    times = Counter(rows(steps[4]))
    for r in steps[3].collect():
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        rows_of[r["source"]].append((n, times[tuple(r)]))
    names = sorted(sizes)
    targets = water_level([sizes[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])
    for s, target in zip(names, targets):
        near(target, rows_of[s])
    assert set(rows(steps[4])) <= set(rows(steps[3]))
    assert max(Counter(i for i, _ in texts(steps[4])).values()) <= 3


def test_packing_holds_every_token_once(steps):
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    copies = Counter(i for i, _ in texts(steps[4]))
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in set(texts(steps[4]))}
    covered, used = Counter(), defaultdict(list)
    for r in steps[5].collect():
        assert r["doc_tokens"] == length[r["doc_id"]]
        for at in range(r["start"], r["start"] + r["length"]):
            covered[r["doc_id"], at] += 1
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == Counter({(i, at): n for i, n in copies.items() for at in range(length[i])})
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024


def test_run_applies_all_stages(spark, steps):
    assert rows(corpus_pipeline.run(spark, "/root/testdata/sf0.001").drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct()) == rows(
        steps[5].drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct()
    )


def test_awkward_rows_and_no_rows(spark, tmp_path):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.schema.names == docs.schema.names, name
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    assert corpus_pipeline.run(spark, written(spark, empty(spark), tmp_path / "none")).collect() == []
