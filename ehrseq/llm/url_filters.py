"""URL rules: host-suffix and path-prefix expressions, hash prefixes, full digests, precedence.

A URL is expanded into every expression that a rule fitting it could be filed under: a suffix of
its host (whole labels) followed by a prefix of its path (whole folders, or no path). Rules are
filed under their host and the folder part of their path. Both sides meet on the first four bytes
of the expression's SHA-256; the whole digest and the rest of the rule's path are compared after.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import lower_ascii

PREFIX_DIGITS = 8  # hexadecimal: four bytes


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty when it is null or has no ``://``.

    Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
    there up to ``?``, ``#`` or the end. Ports and user names stay part of the host.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(authority) + 1), "^[^?#]*", 0)
    return lower_ascii(authority), path


def _folder(path: Column) -> Column:
    """The path up to its last slash, which belongs to it."""
    return F.regexp_extract(path, "(?s)^.*/", 0)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _suffixes(host: Column, labels: int) -> Column:
    parts = F.split(host, r"\.")
    size = F.size(parts)
    numbers = F.sequence(F.lit(1), F.least(size, F.lit(max(labels, 1))))
    return F.transform(numbers, lambda k: F.array_join(F.slice(parts, size - k + 1, k), "."))


def _folders(path: Column, depth: int) -> Column:
    """No path, and each prefix that ends in a slash, at most ``depth`` slashes long."""
    parts = F.split(path, "/")
    most = F.least(F.size(parts) - 1, F.lit(depth))
    numbers = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(numbers, lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), prefixes)


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that decides for each distinct (host, path) of ``urls`` that some rule fits.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains of it when the URL's
    path starts with the rule's. The longest rule (host and path together) wins; among equally
    long ones the longer host, then ``block`` before ``allow``. Rules with a null host or path
    fit nothing. Returns host, path, rule, verdict.

    No URL is expanded deeper than the deepest rule, which loses nothing.
    """
    filed = rules.where("host is not null and path is not null").select(
        lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    deepest = filed.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/")) - 1).alias("slashes"),
    ).first()
    filed = filed.withColumn("rule_digest", _digest(F.concat("rule_host", _folder(F.col("rule_path")))))
    filed = filed.withColumn("hash_prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))
    expanded = (
        urls.select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(_suffixes(F.col("host"), deepest.labels or 0)))
        .withColumn("digest", F.explode(F.transform(_folders(F.col("path"), deepest.slashes or 0), lambda p: _digest(F.concat("suffix", p)))))
        .select("host", "path", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("hash_prefix"))
    )
    fitting = expanded.join(filed, "hash_prefix").where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(
        F.struct(
            F.length(rule).alias("size"),
            F.length("rule_host").alias("host_size"),
            (F.col("rule_verdict") == "block").alias("blocks"),
            rule.alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        )
    )
    return fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, id_column="page_id", url_column="url", default="allow") -> DataFrame:
    """Each page's host, path, deciding rule (null if none fits) and verdict.

    Distinct URLs are judged once, however many pages share them; the join back is an equi-join,
    so adaptive execution can split a URL that many pages share. A page that no rule fits gets
    ``default``. Repeated rows stay repeated; null and empty URLs have empty host and path and
    fit no rule; an empty table gives an empty result. Other columns of ``pages`` are left out, so
    their names cannot clash.
    """
    host, path = split_url(F.col(url_column))
    urls = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    found = matching_rules(urls, rules)
    return urls.join(found, ["host", "path"], "left").select(
        id_column, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
