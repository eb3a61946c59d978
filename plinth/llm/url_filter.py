"""URL filter by rules and by shrunk host reputation.

Rules name a host (with all its subdomains) and a path prefix; the longest rule
that fits a url decides. Other urls are judged by their host's reputation. Its
evidence are labelled page outcomes: here the pages that a rule decides, allowed
or blocked. A host's block rate is shrunk towards its registered domain's, that
towards its suffix's, and that towards the rate of all, each time by a
beta-binomial prior whose weight is the moment estimate of how much rates at
that level differ. A url is blocked if the posterior bound of its host's rate,
Z deviations below the mean, is above MAX_RATE: few or no outcomes never block.

Outcomes are summed by host before they are shuffled; the levels above are sums
of the level below. What is joined back to pages is one row a host, broadcast
only while there are few.

For the tree, a host goes without user info, port and dots at its end. Its
suffix is its last label, or its last two where these are a country's and one of
SECOND (``co.uk``); the registered domain has one label more. A host that is no
longer than its suffix is its own domain, and a numeric or bracketed address is
its own domain and suffix.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule fits it, and its reputation is that of the empty host (allowed, since no
outcome can be known of it); an empty table gives an empty result; repeated rows
each count; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.storage import broadcast_within, checkpoint, row_count

#: (host, path, verdict), as stated for the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Second-level labels under which countries register domains.
SECOND = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org")
MAX_RATE = 0.5
Z = 1.64
BROADCAST_HOSTS = 200_000

#: In SQL, for the oracle: moment estimate of a prior's weight from (m groups, nn outcomes, bb blocked, n2 = sum of n^2, br = sum of b^2/n).
_RHO = "CASE WHEN bb > 0 AND bb < nn AND nn - n2 / nn - (m - 1) > 0 THEN (br - bb * (bb / nn) - (bb / nn) * (1 - bb / nn) * (m - 1)) / ((nn - n2 / nn - (m - 1)) * (bb / nn) * (1 - bb / nn)) ELSE 0.0 END"
_WEIGHT = "CASE WHEN rho <= 0.01 THEN 100.0 WHEN rho >= 0.5 THEN 1.0 ELSE (1 - rho) / rho END"


def parts(pages: DataFrame) -> DataFrame:
    """Add host and path."""
    after = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    out = pages.withColumn("__after", F.coalesce(after, F.lit("")))
    host = F.regexp_extract("__after", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(__after, char_length(__host) + 1)"), r"^[^?#]*", 0)
    lowered = F.translate("__host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return out.withColumn("__host", host).select(*pages.columns, lowered.alias("host"), path.alias("path"))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (host and path of the longest that fits) and ruled (its verdict)."""
    rule = verdict = None
    for host, path, said in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return urls.withColumns({"rule": rule, "ruled": verdict})


_ADDRESS = r"^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*)$"
_COUNTRY = rf"(^|[.])({'|'.join(SECOND)})[.][a-z]{{2}}$"


def with_tree(urls: DataFrame) -> DataFrame:
    """Add site (the host as the tree has it), domain and suffix."""
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")
    long, address = F.col("site").rlike(_COUNTRY), F.col("site").rlike(_ADDRESS)

    def last(n: int) -> Column:
        return F.substring_index("site", ".", -n)

    suffix = F.when(address, F.col("site")).when(long, last(2)).otherwise(last(1))
    domain = F.when(address, F.col("site")).when(long, last(3)).otherwise(last(2))
    return urls.withColumn("site", site).withColumns({"domain": domain, "suffix": suffix})


def _weight(table: DataFrame) -> float:
    """Weight of the prior over a level's groups (n outcomes, b blocked): between 1 and 100."""
    m, nn, bb, n2, br = table.where("n > 0").agg(F.count(F.lit(1)), F.sum("n"), F.sum("b"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("b") * F.col("b") / F.col("n"))).first()
    room = nn - n2 / nn - (m - 1) if nn else 0
    if not nn or not 0 < bb < nn or room <= 0:
        return 100.0
    p = bb / nn
    rho = (br - bb * p - p * (1 - p) * (m - 1)) / (room * p * (1 - p))
    return 100.0 if rho <= 0.01 else 1.0 if rho >= 0.5 else (1 - rho) / rho


def reputation(outcomes: DataFrame) -> DataFrame:
    """From (site, domain, suffix, outcome: blocked true/false, or null if unlabelled): site, rate (posterior mean), low (posterior bound).

    Every site of ``outcomes`` gets a row, also those without labels.
    """
    hosts = checkpoint(outcomes.groupBy("site", "domain", "suffix").agg(F.count("outcome").alias("n"), F.count_if("outcome").alias("b")))
    domains = checkpoint(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    suffixes = checkpoint(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    k_host, k_domain, k_suffix = (_weight(table) for table in (hosts, domains, suffixes))
    nn, bb = suffixes.agg(F.sum("n"), F.sum("b")).first()
    p = bb / nn if nn else 0.0
    few = [broadcast_within(t, row_count(t), BROADCAST_HOSTS) for t in (domains, suffixes)]
    tree = hosts.alias("h").join(few[0].alias("d"), ["domain", "suffix"]).join(few[1].alias("s"), "suffix")
    top = (F.col("s.b") + F.lit(k_suffix * p)) / (F.col("s.n") + F.lit(k_suffix))
    up = (F.col("d.b") + F.lit(k_domain) * top) / (F.col("d.n") + F.lit(k_domain))
    tree = tree.select("site", "h.n", F.lit(k_host).alias("k_host"), ((F.col("h.b") + F.lit(k_host) * up) / (F.col("h.n") + F.lit(k_host))).alias("rate"))
    return tree.select("site", "rate", F.expr(f"rate - {Z} * sqrt(rate * (1 - rate) / (n + k_host + 1))").alias("low"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the site's rate and low, of every page."""
    ruled = checkpoint(with_tree(with_rules(parts(pages.select("page_id", "url")), rules)).drop("url"))
    known = checkpoint(reputation(ruled.select("site", "domain", "suffix", (F.col("ruled") == "block").alias("outcome"))))
    known = broadcast_within(known, row_count(known), BROADCAST_HOSTS)
    out = ruled.join(known, "site", "left")
    said = F.coalesce("ruled", F.when(F.col("low") > F.lit(MAX_RATE), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "rate", "low")


def query(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("low", 6).alias("low"))


def _rule_sql(what) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", what(h, p, v)) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{value}'" for cond, value in fits) + " END"


def _weights_sql(table: str) -> str:
    return f"(SELECT {_WEIGHT} FROM (SELECT {_RHO} AS rho FROM (SELECT CAST(count(*) AS DOUBLE) m, CAST(sum(n) AS DOUBLE) nn, CAST(sum(b) AS DOUBLE) bb, CAST(sum(n * n) AS DOUBLE) n2, sum(b * b / n) br FROM {table} WHERE n > 0)))"


ORACLE = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM u
), r AS (
  SELECT *, {_rule_sql(lambda h, p, v: h + p)} AS rule, {_rule_sql(lambda h, p, v: v)} AS ruled,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS site FROM p
), g AS (
  SELECT site, ruled, CASE WHEN regexp_matches(site, '{_ADDRESS}') THEN 0 WHEN regexp_matches(site, '{_COUNTRY}') THEN 2 ELSE 1 END AS long, string_split(site, '.') AS labels FROM r
), h AS (
  SELECT site, CASE long WHEN 0 THEN site WHEN 1 THEN array_to_string(labels[-2:], '.') ELSE array_to_string(labels[-3:], '.') END AS domain,
    CASE long WHEN 0 THEN site WHEN 1 THEN labels[-1] ELSE array_to_string(labels[-2:], '.') END AS suffix,
    count(ruled) AS n, count(*) FILTER (ruled = 'block') AS b FROM g GROUP BY ALL
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM h GROUP BY domain, suffix
), s AS (
  SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY suffix
), k AS (
  SELECT {_weights_sql('h')} AS k_host, {_weights_sql('d')} AS k_domain, {_weights_sql('s')} AS k_suffix,
    (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0.0 END FROM s) AS p
), t AS (
  SELECT site, h.n, k_host, (h.b + k_host * ((d.b + k_domain * ((s.b + k_suffix * p) / (s.n + k_suffix))) / (d.n + k_domain))) / (h.n + k_host) AS rate
  FROM h JOIN d USING (domain, suffix) JOIN s USING (suffix), k
), w AS (
  SELECT site, rate, rate - {Z} * sqrt(rate * (1 - rate) / (n + k_host + 1)) AS low FROM t
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN low > {MAX_RATE} THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS rate, round(low, 6) AS low
FROM r JOIN w USING (site)
"""
