"""Operator 5: URLs allowed or blocked by rules, else by logistic regression on hashed character trigrams.

Scoring is DataFrame expressions alone. The model is fitted on the driver to the labelled table below; its weights, in
millionths, are whole numbers, so that a score is the same sum in any engine and order. Rules are a chain of conditions,
the longest first; at most MAX_RULES of them.

A null url, or one without `://`, has an empty host and path and gets the model's verdict on them (the intercept's sign).
Rows repeated as they are give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, STEPS, RATE, L2 = 4096, 300, 0.5, 1e-4
MAX_RULES = 1000
#: Multipliers of the three code points, and what is added for the path.
HASH, PATH_SALT = (7919, 104_729, 1_299_709), 2048

# The labelled URLs (host, path). 1 is block.
LABELLED = (
    (0, "docs.python.example", "/library/functions"), (0, "en.encyclopedia.example", "/wiki/history"), (0, "www.university.example", "/research/papers"),
    (0, "news.daily.example", "/article/2021/science"), (0, "blog.gardener.example", "/guide/recipes"), (0, "library.city.example", "/catalogue/books"),
    (0, "www.museum.example", "/en/exhibitions"), (0, "health.agency.example", "/advice/nutrition"), (0, "www.school.example", "/lessons/mathematics"),
    (0, "weather.service.example", "/forecast/today"), (0, "m.magazine.example", "/story/travel"), (0, "forum.builders.example", "/thread/woodwork"),
    (0, "www.journal.example", "/volume/12/abstract"), (0, "code.project.example", "/manual/install.html"), (0, "art.gallery.example", "/de/sammlung"),
    (0, "www.region.example", "/fr/histoire"), (0, "cultura.ciudad.example", "/es/noticias"), (0, "parks.state.example", "/trails/map"),
    (0, "www.orchestra.example", "/concerts"), (0, "kitchen.home.example", "/recipes/soup"), (0, "data.bureau.example", "/tables/2019"),
    (0, "www.astronomy.example", "/en/planets"), (0, "blog.teacher.example", "/posts/reading"), (0, "www.court.example", "/opinions/archive"),
    (1, "casino-bonus.example", "/play/slots"), (1, "www.pokerwin.example", "/jackpot/bonus"), (1, "xxx-adult.example", "/porn/videos"),
    (1, "hotsex.example", "/xxx/gallery"), (1, "cheap-viagra.example", "/pharmacy/buy"), (1, "replica-watches.example", "/buy/cheap"),
    (1, "free-crack.example", "/keygen/download"), (1, "torrentz.example", "/warez/download"), (1, "login-verify.example", "/account/confirm-password"),
    (1, "secure-bank-update.example", "/login/verify"), (1, "ads.clicktrack.example", "/popup/banner"), (1, "tracker.adserver.example", "/pixel/click"),
    (1, "win-prize-now.example", "/claim/free-gift"), (1, "earn-cash-fast.example", "/invest/bitcoin"), (1, "miracle-diet.example", "/pills/buy-now"),
    (1, "payday-loans.example", "/apply/cash"), (1, "live-cams.example", "/adult/chat"), (1, "betting-tips.example", "/odds/bonus"),
    (1, "escort-ads.example", "/girls/city"), (1, "malware-update.example", "/flash/setup.exe"), (1, "spam-seo.example", "/backlinks/cheap"),
    (1, "fake-followers.example", "/buy/likes"), (1, "crypto-double.example", "/airdrop/claim"), (1, "slots-casino.example", "/free-spins"),
)

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def slots(text: str, salt: int) -> list[int]:
    """Hash of each trigram of `^text$`."""
    c = [ord(x) for x in f"^{text}$"]
    return [(c[i] * HASH[0] + c[i + 1] * HASH[1] + c[i + 2] * HASH[2] + salt) % SLOTS for i in range(len(c) - 2)]


def fit(table=LABELLED) -> tuple[list[int], int]:
    """Weights by slot and the intercept, in millionths. A URL's logit is the mean of its trigrams' weights, scaled by
    the factor that training found best left at 1, plus the intercept."""
    rows = [(y, slots(h, 0) + slots(p, PATH_SALT)) for y, h, p in table]
    w, b = [0.0] * SLOTS, 0.0
    for _ in range(STEPS):
        g, gb = {}, 0.0
        for y, s in rows:
            z = sum(w[k] for k in s) / len(s) * 10 + b
            e = y - 1 / (1 + math.exp(-z))
            gb += e
            for k in s:
                g[k] = g.get(k, 0.0) + e * 10 / len(s)
        b += RATE * gb / len(rows)
        for k, x in g.items():
            w[k] += RATE * (x / len(rows) * 10 - L2 * w[k])
    return [round(x * 10e6) for x in w], round(b * 1e6)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path. Upper-casing beyond A to Z is left, unlike lower()."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def logit(host: Column, path: Column, weights: list[int], intercept: int) -> Column:
    """Sum of the trigrams' weights plus the intercept for each trigram: of the logit's sign, a whole number."""
    table = F.expr(f"array({', '.join(f'{x}L' for x in weights)})")

    def codes(text: Column) -> Column:
        return F.transform(F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def total(c: Column, salt: int) -> Column:
        # the sequence is zipped with itself moved by one and by two: a text's cost is linear in its length
        n = F.greatest(F.size(c) - 2, F.lit(0))
        two = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda x, y: x * HASH[0] + y * HASH[1])
        grams = F.zip_with(two, F.slice(c, F.lit(3), n), lambda xy, z: xy + z * HASH[2] + salt)
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, at: a + F.get(table, (at % SLOTS).cast("int")) + intercept)

    return total(codes(host), 0) + total(codes(path), PATH_SALT)


def rule_condition(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, logit): logit in millionths, times the number of trigrams."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"there are more than {MAX_RULES} rules")
    weights, intercept = fit()
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("logit", logit(F.col("host"), F.col("path"), weights, intercept))
    rule, verdict = F.lit(None).cast("string"), F.when((F.col("logit") > 0) | ((F.col("logit") == 0) & F.lit(intercept > 0)), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        holds = rule_condition(F.col("host"), F.col("path"), r)
        rule = F.when(holds, r[1] + r[2]).otherwise(rule)
        verdict = F.when(holds, r[0]).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "logit")


def oracle(rules=RULES) -> str:
    weights, intercept = fit()

    def total(text: str, salt: int) -> str:
        c = f"list_transform(string_split('^' || {text} || '$', ''), lambda c: unicode(c)::bigint)"
        at = f"(cs[i] * {HASH[0]} + cs[i + 1] * {HASH[1]} + cs[i + 2] * {HASH[2]} + {salt}) % {SLOTS} + 1"
        return f"(SELECT coalesce(list_sum(list_transform(range(1, len(cs) - 1), lambda i: w.w[{at}] + {intercept})), 0)::bigint FROM (SELECT {c} AS cs))"

    ordered = sorted(rules, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    when = lambda r: f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    return f"""
      WITH w AS (SELECT [{', '.join(map(str, weights))}]::bigint[] AS w),
      a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
      b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
      s AS (SELECT b.*, {total('host', 0)} + {total('path', PATH_SALT)} AS logit FROM b, w)
      SELECT page_id, host, path, CASE {' '.join(f"{when(r)} THEN '{r[1] + r[2]}'" for r in ordered)} END AS rule,
        CASE {' '.join(f"{when(r)} THEN '{r[0]}'" for r in ordered)} WHEN logit > 0{' OR logit = 0' if intercept > 0 else ''} THEN 'block' ELSE 'allow' END AS verdict, logit
      FROM s"""
