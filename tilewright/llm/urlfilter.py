"""URL filters: rules by host and path, and logistic regression on hashed character n-grams, in SQL functions alone.

The regression learns from a small labelled table, made from lists of words by a rule; digits count alike. With n rows it is fitted in its dual form: the weights are sums of the
rows' features times one number per row, so a step costs n times n whatever the number of buckets, and all steps are one
expression over one row. Judging a url looks its n-grams' buckets up in one array of weights.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and the verdict that the
regression gives to no features; ties go to allow; a very long url is judged whole; repeated rows give equal rows; an empty
table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of n-grams; characters of an n-gram; steps, step size and ridge of the fit. The step is small enough for the
#: fit to converge: steps of 0.5 swing between all and nothing.
BUCKETS, GRAM, STEPS, RATE, RIDGE = 4096, 3, 120, 0.1, 0.01
#: What the intercept adds to the product of two rows; small, so that steps can be long.
BIAS = 0.1
#: Host and path, and the verdict. The longest that fits wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words of hosts to block, of hosts to allow, names without meaning, and words that go with any of them.
BAD = "casino poker bets lottery jackpot bonus prize win pills viagra cheap loans ads adserver track click adult xxx cams spam farm free".split()
GOOD = "news library garden weather university cooking history docs museum science school hospital travel music council book city data maps rail art river bird sky".split()
NAMES = "theres thther tiontion therhe ththea tionsh therre erling ouring ndere stion hation".split()
ANY = "online my best world one day".split()


def labelled_urls() -> tuple[tuple[str, str, int], ...]:
    """The labelled table (host, path, 1: block): each word in some hosts, alone or with others; the rest goes round."""
    names = []
    for words, y in ((BAD, 1), (GOOD, 0)):
        for i, w in enumerate(words):
            names += [(f"{w}-{ANY[i % len(ANY)]}", y), (f"{words[(i + 7) % len(words)]}-{w}", y), (f"{ANY[(i + 2) % len(ANY)]}-{w}" if y else w, y)]
    names += [(w, 0) for w in NAMES]
    return tuple(
        (("", "www.", "m.", "blog.")[k % 4] + name + ".example." + ("com", "net", "org")[k % 3], f"/{('en', 'de', 'fr', 'es')[k // 2 % 4]}/{k * 37 % 9973}" + ("", ".html", "/")[k % 3], y)
        for k, (name, y) in enumerate(names)
    )


LABELLED = labelled_urls()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (A-Z), and the path; both empty where there is no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        best = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def hashed(gram: Column) -> Column:
    """A polynomial of the gram's code points, so that any SQL can say it."""
    code = F.lit(0)
    for i in range(1, GRAM + 1):
        code = code * 31 + F.ascii(F.substr(gram, F.lit(i), F.lit(1)))
    return F.pmod(code, F.lit(BUCKETS)).cast("int")


def buckets(host: Column, path: Column) -> Column:
    """The bucket of each n-gram of host and path; the two parts have n-grams of their own. No characters: none."""

    def of(part: Column, mark: str) -> Column:
        whole = F.concat(F.lit(mark), F.translate(part, "123456789", "000000000"), F.lit("$"))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - GRAM + 1, F.lit(1))), lambda i: F.substr(whole, i, F.lit(GRAM)))
        return F.when(F.length(part) > 0, F.transform(grams, lambda g: hashed(g))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(of(host, "^"), of(path, ">")))


def fit(spark: SparkSession, labelled: tuple = LABELLED) -> list[float]:
    """BUCKETS + 1 weights, the last for the intercept.

    The whole table is one array in one row. In the dual form a row's margin is the sum over rows j of
    a_j (BIAS + shared buckets / 32); a step adds what is left of each row's label, and the ridge shrinks a.
    """
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled)], "i int, host string, path string, y int")
    rows = rows.select(F.struct("i", F.col("y").cast("double").alias("y"), buckets(F.col("host"), F.col("path")).alias("b")).alias("r"))
    table = rows.agg(F.array_sort(F.collect_list("r")).alias("t"))
    table = table.select("t", F.expr(f"transform(t, r -> transform(t, q -> {BIAS}D + size(array_intersect(r.b, q.b)) / 32D))").alias("k"))
    table = table.agg(F.first("t").alias("t"), F.first("k").alias("k"))  # else the steps would compute k anew
    solved = table.select(
        "t",
        F.expr(
            f"""aggregate(sequence(1, {STEPS}), transform(t, r -> 0D), (a, s) ->
                transform(t, r -> a[r.i] * (1 - {RATE}D * {RIDGE}D)
                    + {RATE}D * (r.y - 1 / (1 + exp(-aggregate(t, 0D, (z, q) -> z + k[r.i][q.i] * a[q.i]))))))"""
        ).alias("a"),
    )
    parts = solved.agg(F.first("t").alias("t"), F.first("a").alias("a")).select(F.explode(F.arrays_zip("t", "a")).alias("x")).select("x.t.b", "x.a")
    each = parts.select("a", F.explode(F.concat("b", F.array(F.lit(BUCKETS)))).alias("bucket")).groupBy("bucket").agg((F.sum("a") / F.when(F.col("bucket") == BUCKETS, 1 / BIAS).otherwise(32.0)).alias("w"))
    known = {r["bucket"]: round(r["w"], 6) for r in each.collect()}  # BUCKETS + 1 rows at most
    return [known.get(i, 0.0) for i in range(BUCKETS + 1)]


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple = RULES, labelled: tuple = LABELLED) -> DataFrame:
    """key, host, path, rule, verdict, p_block: the rule's verdict, else block where the regression gives over a half."""
    weights = F.lit(fit(pages.sparkSession, labelled))
    host, path = host_and_path(F.col(url))
    read = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    read = read.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("_r"), buckets(F.col("host"), F.col("path")).alias("_b"))
    margin = F.aggregate("_b", F.element_at(weights, BUCKETS + 1), lambda z, b: z + F.element_at(weights, b + 1))
    judged = read.withColumn("p_block", F.round(1 / (1 + F.exp(-margin)), 4))
    return judged.select(key, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def plain_buckets(host: str, path: str) -> set[int]:
    out = set()
    for part, mark in ((host, "^"), (path, ">")):
        whole = f"{mark}{re.sub('[1-9]', '0', part)}$"
        for i in range(max(1, len(whole) - GRAM + 1) if part else 0):
            code = 0
            for c in whole[i : i + GRAM].ljust(GRAM, "\0"):
                code = code * 31 + ord(c)
            out.add(code % BUCKETS)
    return out


def plain_fit(labelled: tuple = LABELLED) -> list[float]:
    """The weights by a loop over the labelled rows, for tests and for the SQL."""
    rows, y = [plain_buckets(h, p) for h, p, _ in labelled], np.array([float(v) for *_, v in labelled])
    k = np.array([[BIAS + len(a & b) / 32 for b in rows] for a in rows])
    a = np.zeros(len(rows))
    for _ in range(STEPS):
        a = a * (1 - RATE * RIDGE) + RATE * (y - 1 / (1 + np.exp(-(k @ a))))
    out = [0.0] * BUCKETS
    for v, b in zip(a.tolist(), rows):
        for i in b:
            out[i] += v / 32
    return [round(w, 6) for w in out] + [round(float(a.sum()) * BIAS, 6)]


def sql(rules: tuple = RULES, labelled: tuple = LABELLED) -> str:
    """What `judge` gives for the table pages, for DuckDB."""
    weights = plain_fit(labelled)
    grams = lambda part, mark: f"case when length({part}) = 0 then [] else list_transform(range(1, greatest(length('{mark}' || {part} || '$') - {GRAM - 1}, 1) + 1), lambda i: substr('{mark}' || translate({part}, '123456789', '000000000') || '$', i, {GRAM})) end"
    code = "0::bigint"
    for i in range(1, GRAM + 1):
        code = f"({code} * 31 + case when length(g) >= {i} then unicode(substr(g, {i}, 1)) else 0 end)"
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{'rule': '{h}{p}', 'verdict': '{v}'}}" for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)))
    return f"""with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
 h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0, 's')) + 1), '^[^?#]*', 0, 's'), '') as path from u),
 m as (select [{", ".join(f"{w!r}::double" for w in weights)}] as w),
 s as (select page_id, host, path, case {fits} end as r, list_distinct(list_transform(list_concat({grams("host", "^")}, {grams("path", ">")}), lambda g: {code} % {BUCKETS})) as b from h),
 p as (select s.*, round(1 / (1 + exp(-(w[{BUCKETS + 1}] + coalesce(list_sum(list_transform(b, lambda k: w[k + 1])), 0)))), 4) as p_block from s, m)
 select page_id, host, path, r.rule as rule, coalesce(r.verdict, case when p_block > 0.5 then 'block' else 'allow' end) as verdict, p_block from p"""
