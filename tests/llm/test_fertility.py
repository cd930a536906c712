import math
from collections import Counter

import numpy as np
import public_tokenizers as public
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywatch.llm.fertility import (
    FENCE,
    LEAST_GROUP,
    LEAST_SPREAD,
    MEASURES,
    SHORT,
    _scripts,
    judged,
    kept_documents,
    measured,
    op2_fertility,
    repeated_words,
)
from tests.llm.cases import awkward, awkward_rows, empty, small, texts, words, written


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] >= 2 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_counts_and_measures_match_brute_force(spark, folder):
    found = {r["doc_id"]: r for r in op2_fertility(spark, folder).collect()}
    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    model = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    docs = texts(small(spark))
    assert set(found) == {i for i, _ in docs}
    for i, t in docs:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t)
    for i, t in docs[:20]:
        r = found[i]
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert math.isclose(r["chars_per_token"], sum(map(len, words(t))) / len(ids))
        shares = [n / len(ids) for n in Counter(ids).values()]
        assert math.isclose(r["entropy"], -sum(s * math.log2(s) for s in shares) / math.log2(max(2, len(ids))), abs_tol=1e-9)
        pieces = [p for w in words(t) for p in model.encode(w)]
        assert math.isclose(r["byte_share"], sum(map(model.is_byte, pieces)) / len(pieces))


def test_clean_texts_stay_and_noise_goes(spark, tmp_path):
    import random

    rng = random.Random(1)
    plain = [r for r in small(spark).filter("lang = 'en'").collect() if not base(r["text"])[-1]]
    rows = [(r["doc_id"], r["text"], "en", "s", 0) for r in plain]
    noise = [(10_000 + i, " ".join("".join(chr(rng.randrange(0x13000, 0x13400)) for _ in range(6)) for _ in range(200)), "en", "s", 0) for i in range(3)]
    df = spark.createDataFrame(rows + noise, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r["doc_id"]: r["kept"] for r in op2_fertility(spark, written(spark, df, tmp_path)).collect()}
    assert not any(found[i] for i, *_ in noise)
    assert sum(found[i] for i, *_ in rows) == len(rows)


def test_repeated_windows_across_texts_do_not_count():
    codes = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5])
    owner = np.array([0] * 5 + [1] * 11)
    assert repeated_words(codes, owner, 3).tolist() == [0, 10, 0]


def test_awkward_rows(spark, tmp_path):
    folder = written(spark, awkward(spark), tmp_path)
    found = sorted((tuple(r)[:7] for r in op2_fertility(spark, folder).collect()), key=repr)
    assert found == sorted(((r[0], *base(r[1])) for r in awkward_rows()), key=repr)
    docs = awkward(spark)
    kept = kept_documents(docs)
    assert kept.schema == docs.schema
    assert all(not base(r["text"])[-1] for r in kept.collect())


def test_empty_table(spark, tmp_path):
    assert op2_fertility(spark, written(spark, empty(spark), tmp_path)).collect() == []


def test_noise_goes_in_every_language_and_clean_texts_stay(spark, tmp_path):
    import random

    rng = random.Random(2)
    docs = small(spark, "/root/testdata/sf0.01").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], "s", 0) for r in docs]
    clean = {r["doc_id"] for r in docs if not base(r["text"])[-1]}
    noise = {}
    for lang in ("en", "es", "fr", "de"):
        known = sorted({w for r in docs if r["lang"] == lang for w in words(r["text"])[:300]})
        few = rng.sample(known, 12)
        for n in (100, 300, 1000):
            letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 11)))
            makers = {"few words": lambda: rng.choice(few), "hex": lambda: f"{rng.getrandbits(32):08x}", "letters": letters}
            for kind, make in makers.items():
                text = " ".join(make() for _ in range(n))
                assert not base(text)[-1]
                noise[10**9 + len(noise)] = (kind, lang, n)
                rows.append((10**9 + len(noise) - 1, text, lang, "s", 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"]: r["kept"] for r in op2_fertility(spark, written(spark, df, tmp_path)).collect()}
    assert [v for k, v in noise.items() if kept[k]] == []
    assert sum(not kept[i] for i in clean) <= len(clean) // 200


def test_clean_texts_of_rare_scripts_stay(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"], "en", "s", 0) for r in small(spark).filter("lang = 'en'").collect()]
    starts = {"ka": 0x10D0, "ta": 0x0B95, "th": 0x0E01, "hi": 0x0915, "zh": 0x4E00, "am": 0x1200}
    rare = {}
    for lang, first in starts.items():
        own = ["".join(chr(first + rng.randrange(24)) for _ in range(rng.randrange(2, 8))) for _ in range(400)]
        own = [w for w in own if w.isalpha()]
        for n in (30, 2000):
            rare[10**9 + len(rare)] = (lang, n)
            rows.append((10**9 + len(rare) - 1, " ".join(rng.choice(own) for _ in range(n)), lang, "s", 0))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"]: r["kept"] for r in op2_fertility(spark, written(spark, df, tmp_path)).collect()}
    assert [v for k, v in rare.items() if not kept[k]] == []


def test_every_language_with_quartiles_has_a_band_of_its_own(spark):
    each, odd = 25, F.col("id") % 25 == 0
    language = F.floor(F.col("id") / each)
    metrics = spark.range(1200 * each).select(
        "id", F.concat(F.lit("l"), language).alias("lang"), F.lit("latin").alias("script"),
        F.lit(100).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_repeat_words"),
        F.lit(400).cast("bigint").alias("n_tokens"), F.lit(400).cast("bigint").alias("n_lettered"),
        (F.when(odd, 0.5).otherwise(1.0) * (1 + language / 600) + 0.001 * (F.col("id") % 7)).alias("lettered_chars"),
        F.lit(0.0).alias("byte_share"), F.lit(0.7).alias("lettered_entropy"),
    )
    kept = judged(metrics).groupBy((F.col("id") % each == 0).alias("odd"), "kept").count().collect()
    assert {(r["odd"], r["kept"]): r["count"] for r in kept} == {(True, False): 1200, (False, True): 1200 * (each - 1)}


def test_scripts_are_complete():
    samples = {"საქართველო": "georgian", "தமிழ்": "tamil", "ไทย": "thai", "हिन्दी": "devanagari", "አማርኛ": "ethiopic", "中文": "han"}
    samples |= {"ひらがなカタカナ": "kana", "한국어": "hangul", "বাংলা": "bengali", "Ωμέγα": "greek", "12 -- !": "other", "": "other"}
    assert _scripts([t.encode() for t in samples]) == list(samples.values())


def quantile(values, share):
    """The smallest value with at least that share of all values up to it."""
    ordered = sorted(values)
    return ordered[max(0, math.ceil(share * len(ordered)) - 1)]


def plain_verdicts(rows):
    """The verdict of every row (a dictionary of its measures), group by group."""
    length = lambda r: math.log2(max(r["n_lettered"], 2))
    good = [r for r in rows if not r["base_failed"]]
    bands = {}
    for kind in ("lang", "script"):
        for key in {r[kind] for r in good if r[kind] is not None}:
            own = [r for r in good if r[kind] == key]
            if len(own) < LEAST_GROUP:
                continue
            classes = {}
            for r in own:
                classes.setdefault(math.floor(length(r)), []).append(r)
            of = [
                (len(c), sum(1 / length(r) for r in c) / len(c), {m: quantile([r[m] for r in c], 0.5) for m in MEASURES})
                for c in classes.values()
            ]
            n = sum(c[0] for c in of)
            mean = lambda f: sum(c[0] * f(c) for c in of) / n
            usual = {m: mean(lambda c, m=m: c[2][m]) for m in ("lettered_chars", "byte_share")}
            u, b = mean(lambda c: c[1]), mean(lambda c: c[2]["lettered_entropy"] / c[1])
            uu, ub = mean(lambda c: c[1] ** 2), mean(lambda c: c[2]["lettered_entropy"])
            slope = (ub - u * b) / (uu - u * u) if uu - u * u > 1e-9 else 0.0
            usual["lettered_entropy"] = b - slope * u

            def off(r, m, usual=usual, slope=slope):
                there = usual[m] if m != "lettered_entropy" else (usual[m] + slope / length(r)) / length(r)
                return (r[m] - there) / math.sqrt(1 + SHORT / max(r["n_lettered"], 1))

            fences = {}
            for m in MEASURES:
                low, high = (quantile([off(r, m) for r in own], q) for q in (0.25, 0.75))
                spread = max(high - low, LEAST_SPREAD[m] * (usual[m] if m == "lettered_chars" else 1))
                fences[m] = (low - FENCE[m][0] * spread, high + FENCE[m][1] * spread)
            bands[kind, key] = off, fences
    out = []
    for r in rows:
        off, fences = bands.get(("lang", r["lang"])) or bands.get(("script", r["script"])) or (None, {})
        out.append(not r["base_failed"] and all(a <= off(r, m) <= b for m, (a, b) in fences.items()))
    return out


def test_verdicts_match_a_plain_twin(spark):
    """Trend, quartiles, fences and the fall back to the script, over tables whose quantiles are exact."""
    docs = small(spark).select("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("lang"), F.col("text").alias("_text"))
    noise = [(10_000 + i, "en", " ".join(f"{(i * 7919 + k * 104729) % 16**6:06x}" for k in range(150))) for i in range(6)]
    noise += [(20_000 + i, "rare", "one two three four five six seven eight nine ten eleven " + "ab " * i) for i in range(4)]
    docs = docs.unionByName(spark.createDataFrame(noise, "doc_id bigint, lang string, _text string"))
    table = measured(docs, ["doc_id", "lang"]).persist()
    found = {r["doc_id"]: r for r in judged(table).collect()}
    rows = [{**found[r["doc_id"]].asDict()} for r in table.select("doc_id").collect()]
    wanted = plain_verdicts(rows)
    assert [r["kept"] for r in rows] == wanted and 0 < sum(wanted) < len(wanted)
    assert not any(found[10_000 + i]["kept"] for i in range(6))
    table.unpersist()
