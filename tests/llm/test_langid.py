import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatch.llm import langid
from tests.llm.cases import awkward, awkward_rows, empty, small, texts, words, written


class Brute:
    """Interpolated Kneser-Ney of one language by plain dictionaries."""

    def __init__(self, counts, order):
        self.order = order
        self.levels = {order: Counter()}
        for word, n in counts.items():
            padded = "\x02" * (order - 1) + word + "\x03"
            for i in range(len(padded) - order + 1):
                self.levels[order][padded[i : i + order]] += n
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.discounts = {}
        for k, c in self.levels.items():
            once, twice = (sum(v == r for v in c.values()) for r in (1, 2))
            self.discounts[k] = once / (once + 2 * twice) if once and twice else 0.5

    def chance(self, gram):
        k = len(gram)
        shorter = self.chance(gram[1:]) if k > 1 else 1 / (len(self.levels[1]) + 1)
        after = [v for g, v in self.levels[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return shorter
        d = self.discounts[k]
        return max(self.levels[k][gram] - d, 0) / sum(after) + d * len(after) / sum(after) * shorter


def test_models_match_plain_dictionaries():
    counts = {"a": {"banana": 3, "bandana": 1, "an": 7, "naan": 2}, "b": {"kiki": 2, "ban": 1, "été": 4}}
    brute = {x: Brute(c, 3) for x, c in counts.items()}
    rows = [(i, g, n) for i, x in enumerate("ab") for g, n in brute[x].levels[3].items()]
    models = langid.Models(["a", "b"], pd.DataFrame(rows, columns=["lang", "gram", "n"]), 3)
    for word in ("banana", "kiki", "zzz", "téban"):
        total, n = models.of_words([word.encode()])
        padded = "\x02\x02" + word + "\x03"
        for k, x in enumerate("ab"):
            expected = sum(math.log2(brute[x].chance(padded[i : i + 3])) for i in range(len(word) + 1))
            assert total[0, k] == pytest.approx(expected, rel=1e-4)
        assert n[0] == len(word) + 1
    characters = ["\x03", *"abndkitéz"]
    for context in ("\x02\x02", "an", "zz", "ki"):
        known = [c for c in brute["a"].levels[1]]
        total = sum(brute["a"].chance(context + c) for c in known)
        assert total + brute["a"].chance(context + "?") == pytest.approx(1)
    assert len(characters) > 0


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["lang"] for r in small(spark, folder).collect()}
    found = langid.op9_kneser_ney(spark, folder).collect()
    assert len(found) == len(labels)
    right = Counter()
    for r in found:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
        if r["held_out"] and r["lang_pred"] != "und" and labels[r["doc_id"]]:
            right[r["lang_pred"] == labels[r["doc_id"]]] += 1
    assert right[True] / sum(right.values()) > 0.97


def test_only_labels_of_training_rows_matter(spark):
    docs = small(spark)
    is_held = langid.crc_remainder(F.col("doc_id"), 4) == 2
    changed = docs.withColumn("lang", F.when(is_held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    rows = lambda df: sorted(map(tuple, langid.identify(df, is_held).collect()))
    assert rows(docs) == rows(changed)


def test_awkward_rows(spark, tmp_path):
    found = langid.op9_kneser_ney(spark, written(spark, awkward(spark), tmp_path)).collect()
    assert len(found) == len(awkward_rows())
    by_text = defaultdict(set)
    letters = {i: any(c.isalpha() for w in words(t) for c in w) for i, t in texts(awkward(spark)) if i is not None}
    for r in found:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]])
            by_text[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_a_strange_text_is_rejected(spark):
    docs = small(spark, "/root/testdata/sf0.01").select("doc_id", "lang", "text")
    models, calibration = langid.fit(docs)
    strange = spark.createDataFrame([(1, "xqzj wvkx " * 60), (2, "the thing that is in the other " * 20)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in langid.predict(strange, models, calibration, ["doc_id"]).collect()}
    assert found[1]["rejected"] and found[2]["lang_pred"] == "en" and not found[2]["rejected"]


def test_nothing_to_learn_from(spark, tmp_path):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.op9_kneser_ney(spark, written(spark, docs, tmp_path)).collect()} == {"und"}
    assert langid.op9_kneser_ney(spark, written(spark, empty(spark), tmp_path / "none")).collect() == []


def test_words_are_their_letters():
    points, lengths = langid.letter_words(["Été,".encode(), b"12", b"a1B"])
    assert "".join(map(chr, points)) == "étéab" and lengths.tolist() == [3, 0, 2]
    assert isinstance(points, np.ndarray)


def test_every_language_is_learned_however_small(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_GRAMS", 3000)
    few = {f"l{i}": " ".join(chr(0x3B1 + i) + chr(0x3B1 + (i + k) % 24) for k in range(3)) for i in range(12)}
    docs = small(spark).select("doc_id", "lang", "text").union(
        spark.createDataFrame([(10**6 + i, x, t) for i, (x, t) in enumerate(few.items())], "doc_id bigint, lang string, text string")
    )
    models, calibration = langid.fit(docs)
    known = {r["lang"] for r in docs.filter("text is not null").select("lang").distinct().collect() if r["lang"]}
    assert set(models.langs) == known and not set(few) & set(calibration)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(few.values())], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in langid.predict(asked, models, calibration, ["doc_id"]).collect()}
    assert [found[i]["lang_pred"] for i in range(len(few))] == list(few)
    assert not any(r["rejected"] for r in found.values())


def test_a_bound_on_ngrams_keeps_all_of_the_sample(spark, monkeypatch):
    docs = small(spark).select("doc_id", "lang", "text")
    monkeypatch.setattr(langid, "MOST_GRAMS", 12_000)
    spread = Counter()

    class Seen(Exception):
        pass

    def look(self, langs, counted, order=langid.ORDER):
        spread.update(counted["n"].tolist())
        raise Seen

    monkeypatch.setattr(langid.Models, "__init__", look)
    with pytest.raises(Seen):
        langid.fit(docs)
    assert spread[1] > 0 and spread[2] > 0 and sum(spread.values()) <= 12_000
