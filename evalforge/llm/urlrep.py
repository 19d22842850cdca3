"""Operator 12: URL filter by empirical-Bayes host reputation.  DataFrame and SQL functions only.

A labelled page is an outcome of its host: bad or not.  Bad rates are shrunk
down a hierarchy of beta-binomial priors: the suffix (`org`) towards the whole
corpus, the registered domain (`example.org`) towards its suffix, the host
towards its domain.  A child with n outcomes of which k are bad, under a parent
of rate m, has the posterior Beta(s m + k, s (1 - m) + n - k).  The weight s of
the parent is estimated for each level from the labelled outcomes: analysis of
variance of the children within their parents gives the intraclass correlation
r, and s = (1 - r) / r, held within LEAST_WEIGHT and MOST_WEIGHT.  A host is
blocked if the lower posterior bound of its bad rate exceeds ``limit``: one
unlucky page cannot block a host, and a host never seen takes after its domain.

The bound is the quantile of the posterior's log-odds by their first three
cumulants (digamma, trigamma and tetragamma functions as series, the quantile by
Cornish and Fisher's expansion): a 95 % bound covers 94 to 96 % from Beta(1, 1) on.

Rules come first: a rule `host/path` fits its host and all subdomains where the
url's path starts with the rule's; the longest rule wins (of equally long ones
the longer host, then `block`).  Rules are a parameter and stand in the plan.

Pages meet hosts in a join on host that Spark can split, and every count is a
partial aggregate: a host with a third of all pages is no hot task.

Defined cases: null urls and urls without `://` have empty host and path, which
are a host like any other; a host keeps its port and user name, its domain does
not; addresses of digits are domains of their own; null page ids have no label;
labels with both fields null are none; several labels or pages of one id each
count; without labels the rate is a half under the weakest prior and all is
allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .registry import query

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LIMIT, Z = 0.5, 1.6448536269514722  # bad rate; normal quantile of the bound (95 %)
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")  # with a country of two letters behind them: part of the suffix


# ---------------------------------------------------------------- urls and rules

def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<size, host_size, verdict, rule> of the rule that decides, or null."""
    best = [F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>")]
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {verdict}")
        own, slash, way = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + way))
        best.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(len(own)).alias("host_size"),
                                          F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*best))  # "block" is the larger verdict


def host_family(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    bare = F.rtrim(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), F.lit("."))
    last = [F.substring_index(bare, ".", -k) for k in (1, 2, 3)]
    two = (F.char_length(last[0]) == 2) & F.substring_index(last[1], ".", 1).isin(*SECOND) & (last[1] != last[0])
    number = F.regexp_like(bare, F.lit(r"^[0-9.]+$"))
    return (F.when(number, bare).when(two, last[2]).otherwise(last[1]),
            F.when(number, F.lit("")).when(two, last[1]).otherwise(last[0]))


# ---------------------------------------------------------------- reputation

def anova(children: DataFrame, parent: str) -> Row:
    """Sums over the children (n outcomes, k bad) within their parents; terms are rounded to decimals, so that their
    sums do not depend on the order."""
    exact = lambda e: F.expr(f"cast({e} as decimal(32, 12))")
    fam = (children.where("n > 0").groupBy(F.col(parent).alias("parent"))
           .agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("c"),
                F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(exact("k * k / n")).alias("t")))
    return fam.agg(F.count(F.lit(1)).alias("parents"), F.sum("c").alias("children"), F.sum("n").alias("n"), F.sum("k").alias("k"),
                   F.sum("t").cast("double").alias("t"), F.sum(exact("k * k / n")).cast("double").alias("p"),
                   F.sum(exact("q / n")).cast("double").alias("r")).first()


def prior_weight(x: Row) -> float:
    """Outcomes that the parent's rate is worth: (1 - r) / r of the intraclass correlation r."""
    between, within = (x["children"] or 0) - x["parents"], (x["n"] or 0) - (x["children"] or 0)
    if between <= 0 or within <= 0:
        return LEAST_WEIGHT if between <= 0 else MOST_WEIGHT
    msb, msw = (x["t"] - x["p"]) / between, (x["k"] - x["t"]) / within
    size = (x["n"] - x["r"]) / between
    spread = msb + (size - 1) * msw
    rho = (msb - msw) / spread if spread > 0 else 0.0
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, (1 - rho) / rho)) if rho > 0 else MOST_WEIGHT


def digamma(x: str) -> str:
    y = f"({x} + 6)"
    return (f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6))"
            + "".join(f" - 1 / ({x} + {i})" for i in range(6)) + ")")


def trigamma(x: str) -> str:
    y = f"({x} + 6)"
    return (f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7))"
            + "".join(f" + 1 / (({x} + {i}) * ({x} + {i}))" for i in range(6)) + ")")


def tetragamma(x: str) -> str:
    y = f"({x} + 6)"
    return (f"(-1 / ({y} * {y}) - 1 / pow({y}, 3) - 1 / (2 * pow({y}, 4)) + 1 / (6 * pow({y}, 6))"
            + "".join(f" - 2 / pow({x} + {i}, 3)" for i in range(6)) + ")")


def lower_bound(a: str, b: str, z: float) -> str:
    """SQL of the lower posterior bound of Beta(a, b); DOUBLE a and b above zero."""
    spread = f"({trigamma(a)} + {trigamma(b)})"
    skew = f"({tetragamma(a)} - {tetragamma(b)})"
    return (f"(1 / (1 + exp({digamma(b)} - {digamma(a)} + {z} * sqrt{spread}"
            f" - {(z * z - 1) / 6} * {skew} / {spread})))")


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k) of every host of ``pages`` (page_id, host): labelled outcomes and bad ones, 0 without any."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    by_page = (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
               .groupBy(F.col("doc_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("k")))
    zero = F.lit(0).cast("long")
    seen = pages.groupBy("host").agg(zero.alias("n"), zero.alias("k"))
    held = pages.join(by_page, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return seen.union(held).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def reputation(pages: DataFrame, labels: DataFrame, z: float = Z) -> DataFrame:
    """(host, domain, suffix, n, k, rate, bound) of every host of ``pages`` (page_id, host)."""
    domain, suffix = host_family(F.col("host"))
    hosts = written(outcomes(pages, labels).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    x = anova(suffixes.withColumn("all", F.lit("")), "all")
    s1, s2, s3 = prior_weight(x), prior_weight(anova(domains, "suffix")), prior_weight(anova(hosts, "domain"))
    m0 = ((x["k"] or 0) + 0.5) / ((x["n"] or 0) + 1)
    shrunk = lambda s, m: (F.lit(s) * m + F.col("k")) / (F.lit(s) + F.col("n"))
    top = suffixes.select("suffix", shrunk(s1, F.lit(m0)).alias("m1"))
    mid = domains.join(top, "suffix").select("domain", "suffix", shrunk(s2, F.col("m1")).alias("m2"))
    post = hosts.join(mid, ["domain", "suffix"]).withColumns({
        "a": F.lit(s3) * F.col("m2") + F.col("k"), "b": F.lit(s3) * (1 - F.col("m2")) + F.col("n") - F.col("k")})
    return post.select("host", "domain", "suffix", "n", "k", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"),
                       F.expr(lower_bound("a", "b", z)).alias("bound"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, bad_rate, bound of every row of ``pages`` (page_id, url)."""
    host, path = url_parts(F.col("url"))
    parsed = written(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    known = reputation(parsed.select("page_id", "host"), labels, z)
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return (parsed.join(known, "host").withColumn("rule", rule)
            .select("page_id", "host", "path", F.col("rule.rule").alias("rule"),
                    F.coalesce("rule.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
                    F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), F.col("rate").alias("bad_rate"), "bound"))


def _weight(level: str) -> str:
    """SQL of ``prior_weight`` over the sums of a level."""
    return f"""
  SELECT n, k, CASE WHEN children <= parents THEN {LEAST_WEIGHT} WHEN n <= children OR rho <= 0 THEN {MOST_WEIGHT}
                    ELSE least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, (1 - rho) / rho)) END AS s
  FROM (SELECT *, CASE WHEN spread > 0 THEN (msb - msw) / spread ELSE 0 END AS rho
        FROM (SELECT *, msb + ((n - r) / (children - parents) - 1) * msw AS spread
              FROM (SELECT *, (t - p) / (children - parents) AS msb, (k - t) / (n - children) AS msw
                    FROM (SELECT count(*) AS parents, coalesce(sum(c), 0) AS children, coalesce(sum(n), 0)::double AS n,
                                 coalesce(sum(k), 0)::double AS k, sum(t)::double AS t,
                                 sum((k * k / n)::decimal(32, 12))::double AS p, sum((q / n)::decimal(32, 12))::double AS r
                          FROM (SELECT parent, sum(n)::double AS n, sum(k)::double AS k, count(*) AS c,
                                       sum(n * n)::double AS q, sum((k * k / n)::decimal(32, 12)) AS t
                                FROM {level} WHERE n > 0 GROUP BY parent)))))"""


_RULES_SQL = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for v, r in RULES)


@query("op12_url_reputation", sql=f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM v),
l AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS k
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, coalesce(sum(n), 0)::double AS n, coalesce(sum(k), 0)::double AS k
  FROM p LEFT JOIN l ON doc_id = page_id GROUP BY host),
b AS (SELECT *, rtrim(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '.') AS bare FROM h),
c AS (SELECT *, string_split(bare, '.') AS x FROM b),
e AS (
  SELECT host, n, k, bare, x, regexp_matches(bare, '^[0-9.]+$') AS num,
         len(x) > 1 AND length(x[-1]) = 2 AND x[-2] IN ({", ".join(f"'{s}'" for s in SECOND)}) AS two
  FROM c),
hosts AS (
  SELECT host, n, k, CASE WHEN num THEN '' WHEN two THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix,
         CASE WHEN num THEN bare WHEN two THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS parent
  FROM e),
domains AS (SELECT parent AS domain, suffix AS parent, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT parent AS suffix, '' AS parent, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
w1 AS ({_weight("suffixes")}),
w2 AS ({_weight("domains")}),
w3 AS ({_weight("hosts")}),
m1 AS (SELECT suffix, (s * ((w1.k + 0.5) / (w1.n + 1)) + x.k) / (s + x.n) AS m FROM suffixes x, w1),
m2 AS (SELECT domain, x.parent AS suffix, (s * m + x.k) / (s + x.n) AS m
       FROM domains x JOIN m1 ON m1.suffix = x.parent, w2),
ab AS (SELECT host, x.n, x.k, s * m + x.k AS a, s * (1 - m) + x.n - x.k AS b
       FROM hosts x JOIN m2 ON m2.domain = x.parent AND m2.suffix = x.suffix, w3),
rep AS (SELECT host, n, k, a / (a + b) AS rate, {lower_bound("a", "b", Z)} AS bound FROM ab),
r(rh, rp, rule, verdict) AS (VALUES {_RULES_SQL}),
f AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN r
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       rep.n::bigint AS n_labelled, rep.k::bigint AS n_bad, rate AS bad_rate, bound
FROM p JOIN rep ON rep.host = p.host LEFT JOIN f ON f.host = p.host AND f.path = p.path""")
def op12_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the label of the same id; a page of low quality or a toxic one is bad."""
    read = lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return filter_urls(read("pages").select("page_id", "url"), read("labels").select("doc_id", "quality", "toxic"))
