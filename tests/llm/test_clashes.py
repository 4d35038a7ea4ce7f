"""Every operator and stage on tables with clashing columns and very many rows of one doc_id."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from molquarry.llm import decontaminate, language_id, ngram_join, packing, quality_classifier, quality_rules, secrets, shards, substring_dedup, toxicity
from molquarry.llm.queries import tokenizer_path

#: Names that operators use inside.
NAMES = """id y x h t row crc ids ids_crc32 at n first last per offset sequence_id piece start end length size kind seed salt place open
source source_at doc digest words seeds gaps mark parts tree cluster component leader label labels block group_id part pivot bits set cells d1 d2
n_shingles component_id lang_pred score held_out predicted languages good bin anomaly kept base_failed n_words word_chars n_symbols n_dup_lines
n_repeat_words spans base_spans items n_hit slot shard record byte_offset bucket quality toxic item_id node u v m a b g w c value count
_n _part _at _rank _more _masked _pivots _main _all _most _first _from _took _key _size _sum _blocks _grams _p""".split()
REPEATS = 10_000


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 8)))
    out = [(i, ". ".join(" ".join(word() for _ in range(8)) for _ in range(6)) + ".") for i in range(40)]
    out += [(40, out[3][1]), (41, out[4][1] + " password=abcdefgh12345"), (42, None), (43, "")]
    return out


@pytest.fixture(scope="module")
def plain(spark):
    """The rows, and REPEATS rows of one doc_id with three texts."""
    rows = [*texts(), *((77, texts()[i % 3 + 10][1]) for i in range(REPEATS))]
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source_ string, n_chars long").withColumnRenamed("source_", "origin")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({c: F.lit(f"kept {c}") for c in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    df = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    return df.withColumns({c: F.lit("x") for c in NAMES if c not in ("quality", "toxic")})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(texts()[7][1].split()[5:20]))], "item_id long, text string").withColumns({c: F.lit("x") for c in NAMES if c != "item_id"})


def bag(df):
    return collections.Counter(map(repr, df.collect()))


OPERATORS = {
    "op1": lambda d, labels, bench: ngram_join.join_ngrams(d, 3, 90, 100),
    "op2": lambda d, labels, bench: language_id.identify(d),
    "op3": lambda d, labels, bench: substring_dedup.shared_passages(d),
    "op4": lambda d, labels, bench: toxicity.score(d, labels),
    "op5": lambda d, labels, bench: quality_rules.judge(d, labels),
    "op6": lambda d, labels, bench: packing.pack(packing.pieces_of(d, tokenizer_path())).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op7": lambda d, labels, bench: quality_classifier.classify(d, labels),
    "op8": lambda d, labels, bench: secrets.scan(d).select("doc_id", secrets.named(F.col("spans")).alias("s")),
    "op10": lambda d, labels, bench: decontaminate.match_items(d, bench),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_do_not_see_other_columns(plain, clashing, labels, benchmark, name):
    want, got = (bag(OPERATORS[name](d, labels, benchmark)) for d in (plain, clashing))
    assert got == want
    if name not in ("op3", "op6"):
        assert sum(got.values()) == 44 + REPEATS


def test_shards_do_not_see_other_columns(spark, plain, clashing, tmp_path):
    read = {}
    for k, d in {"a": plain, "b": clashing}.items():
        shards.write_shards(d, str(tmp_path / k), tokenizer_path(), sequence=256)
        read[k] = bag(shards.read_from(spark, str(tmp_path / k), sequence=256))
    assert read["a"] == read["b"]


STAGES = {
    "language_id": lambda d, bench: language_id.keep_identified(d),
    "ngram_jaccard_join": lambda d, bench: ngram_join.keep_first(d),
    "benchmark_decontamination": decontaminate.remove_items,
    "secret_scans": lambda d, bench: secrets.mask(d),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_all_columns(plain, clashing, benchmark, name):
    out = STAGES[name](clashing, benchmark)
    assert out.columns == clashing.columns and out.schema == clashing.schema
    kept = out.select(*plain.columns)
    assert bag(kept) == bag(STAGES[name](plain, benchmark).select(*plain.columns))
    assert out.filter(" or ".join(f"`{c}` is null or `{c}` <> 'kept {c}'" for c in NAMES)).isEmpty()
    changed = bag(plain) != bag(kept)
    assert changed


def test_samples_are_bounded(plain, labels, monkeypatch):
    """Many rows of one drawn doc_id count as one in what the driver learns from."""
    seen = {}
    monkeypatch.setattr(language_id, "Languages", lambda rows: seen.setdefault("languages", list(rows)))
    language_id.learnt(plain, "doc_id", "text", "lang", 3, 1)
    assert 0 < len(seen["languages"]) <= 45
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.setdefault("toxic", rows) and None)
    toxicity.score(plain, labels)
    assert 0 < len(seen["toxic"]) <= 45
    monkeypatch.setattr(quality_classifier, "train", lambda pos, unl, prior: seen.update(pos=pos, unl=unl) or quality_classifier.Network(pos.shape[1], __import__("numpy").random.default_rng(0)))
    monkeypatch.setattr(quality_classifier, "class_prior", lambda pos, unl: 0.5)
    quality_classifier.classify(plain, labels)
    assert len(seen["pos"]) <= 45 and len(seen["unl"]) <= 45
