"""Very long runs through the secret scans: the matcher must not recurse once for each piece."""

import random
import re

from pyspark.sql import functions as F

from molquarry.llm import secrets

SLUG = re.compile(r"/?([a-z]+[0-9]{0,4}[/_-]){2,}[a-z]*[0-9]{0,4}")


def test_slugs_are_what_the_pattern_says(spark):
    rng = random.Random(8)
    runs = ["".join(rng.choice("ab12/_-") for _ in range(rng.randint(1, 12))) for _ in range(3000)] + ["/", "a-b-", "/a-b", "a-b-c12345", "a12345-b-c", "//a-b-c"]
    df = spark.createDataFrame([(r,) for r in runs], "run string").select("run", secrets.slug(F.col("run")).alias("slug"))
    assert [r["run"] for r in df.collect() if r["slug"] != bool(SLUG.fullmatch(r["run"]))] == []


def test_runs_of_megabytes(spark):
    rng = random.Random(9)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["ab1-" * 2_500_000, "/" + "part1/" * 1_600_000, "word-" * 2_000_000, draw(base64, 1_000_000), draw("0123456789abcdef", 1_000_000), "A" * 1_000_000, "1-" * 500_000, "password=" + draw(base64[:62], 1_000_000)]
    df = spark.createDataFrame(list(enumerate(f"x {t} y" for t in texts)), "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in secrets.scan(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert n == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1}
    size = {r["doc_id"]: r["n"] for r in secrets.mask(df).select("doc_id", F.length("text").alias("n")).collect()}
    assert {i for i in size if size[i] == len(texts[i]) + 4} == {0, 1, 2, 5, 6}
