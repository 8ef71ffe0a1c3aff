"""URL filters: pattern rules, each indexed by its rarest literal token.

A rule's pattern is turned into a regular expression and into the tokens that any fitting URL holds whole. The
rule is filed under the one of them that the fewest URLs of the corpus have; the tokens of a URL fetch its candidate rules,
and only those run their expression. All of it is joins and SQL functions over different URLs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.storage import free_name, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Up to so many entries an index is sent to every task; the entries of a rule list beyond it are joined by shuffling.
MOST_SENT = 100_000
# A token is a run of digits, letters and non-ASCII characters.
_NO_TOKEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` over host and path: ``||`` starts at the host or one of its labels, ``*`` is any text,
    ``^`` a character that is no part of a token or the end; anything else stands for itself.
    A rule with a higher ``rank`` wins, then the longer pattern, then the later in the alphabet."""

    pattern: str
    verdict: str
    rank: int = 0

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    def expression(self) -> str:
        special = {"*": "[\\s\\S]*", "^": r"(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|$)"}
        return (r"^(?:[^/]*\.)?" if self.pattern.startswith("||") else "") + "".join(special.get(c) or re.escape(c) for c in self.name)

    def tokens(self) -> list[str]:
        """Tokens that every fitting text holds whole: not next to ``*`` nor at an end that is open."""
        marked = ("^" if self.pattern.startswith("||") else "*") + self.name + "*"
        return sorted({m[0] for m in re.finditer(r"(?<![*0-9A-Za-z\x80-\U0010ffff])[0-9A-Za-z\x80-\U0010ffff]+(?![*0-9A-Za-z\x80-\U0010ffff])", marked)})


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and its subdomains, and paths that start with ``path``."""
    return UrlRule(f"||{host}{path}", verdict, rank=1)


# The list that the production query applies.
LISTED = [host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"),
          host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow")]
# The method's own patterns, for URLs that no listed rule fits; without a fitting one a URL is allowed.
PATTERNS = [UrlRule(p, "block") for p in (
    "||spam-", "||ads.", "||adserver.", "||tracker.", "||casino.", "/casino/", "/poker/", "/porn/", "/xxx/", "-casino-", "-poker-", "/wp-login.php",
    "/affiliate/*/click/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """(token, rule, verdict, rank, expression): each rule under its rarest token in ``urls`` (tokens).

    A rule without a sure token is filed under the empty token, which every URL has.
    """
    spark = urls.sparkSession
    schema = "no int, token string, rule string, verdict string, rank int, expression string"
    rows = [(no, token, r.name, r.verdict, r.rank, r.expression()) for no, r in enumerate(rules) for token in r.tokens() or [""]]
    filed = spark.createDataFrame(rows, schema)
    sent = F.broadcast if len(rows) <= MOST_SENT else lambda df: df
    counts = (urls.select(F.explode("tokens").alias("token")).join(sent(filed.select("token").distinct()), "token")
              .groupBy("token").agg(F.count("*").alias("n")))
    rarest = filed.join(counts, "token", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least"))
    return sent(filed.join(rarest.select("no", F.col("least.token").alias("token")), ["no", "token"]).drop("no"))


def judge_urls(pages: DataFrame, rules: list[UrlRule] | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule, verdict and pattern.

    The winning rule gives the verdict; its name is in ``rule`` if it is a listed one (rank above 0), else in ``pattern``.
    A URL without a fitting rule, or null, gets ``default``. Columns of these names are replaced; all rows
    stay, repeated ones too; an empty table gives an empty result. URLs of any length are judged whole.
    """
    rules = LISTED + PATTERNS if rules is None else rules
    added = ["host", "path", "rule", "verdict", "pattern"]
    kept = pages.drop(*added)
    once = pages.select("url").where("url is not null").distinct()
    target = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    urls = written(once.select("url", target.alias("target")).withColumn(
        "tokens", F.array_distinct(F.concat(F.split("target", _NO_TOKEN), F.array(F.lit(""))))), "urls")
    fits = (urls.select("url", "target", F.explode("tokens").alias("token")).join(rule_index(urls, rules), "token")
            .where(F.expr("regexp_like(target, expression)")))
    won = fits.groupBy("url").agg(F.max(F.struct("rank", F.length("rule").alias("size"), "rule", "verdict")).alias("won"))
    key, best = free_name(kept.columns, "url_key"), free_name(kept.columns, "won")
    judged = kept.join(won.toDF(key, best), F.col("url") == F.col(key), "left")
    listed = F.col(best)["rank"] > 0
    return judged.select(
        *kept.columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(listed, F.col(best)["rule"]).alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"),
        F.when(~listed, F.col(best)["rule"]).alias("pattern"))
