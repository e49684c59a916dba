"""URL filters: a trie over reversed host labels and path segments.

An entry (host, path) fits a url whose host is that host or a subdomain of it and whose path
starts with the entry's. Of all entries that fit, the longest (host and path together) decides,
whether it allows or blocks; of two that are equally long, the one with the longer host. A url that none fits gets the
default verdict. Of entries given twice the last counts.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
up to ``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path and gets the
default. A very long url counts as a whole. Rows that repeat are judged each on its own; an empty table gives no rows; an
input column named like a result gives way.
"""

from __future__ import annotations

import bisect
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A trie is broadcast up to so many entries; more are joined by key.
MAX_TRIE = 200_000

#: Keys of a node that no segment has.
_ENDS, _SIZES = 0, 1
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_OUT = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url or "")
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


class Trie:
    """Nodes are (children by label or whole segment, entries by unfinished last segment)."""

    def __init__(self, rules) -> None:
        self.hosts: dict = {}
        for verdict, host, path in rules:
            node = self.hosts
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, last = path.split("/")  # "/en/" -> "", "en" | ""
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(_ENDS, {})
            ends[last] = (verdict, host + path, len(host))
            sizes = node.setdefault(_SIZES, [])  # of the unfinished segments that entries end with here, in order
            if len(last) not in sizes:
                bisect.insort(sizes, len(last))

    def find(self, host: str, path: str) -> tuple[str, str, int] | None:
        best, node, segments = None, self.hosts, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            at = node.get("/")
            for segment in segments:
                if at is None:
                    break
                ends = at.get(_ENDS, {})
                for n in at.get(_SIZES, ()):  # entries that end within this segment, by the lengths that there are
                    if n > len(segment):
                        break
                    entry = ends.get(segment[:n])
                    if entry and (best is None or (len(entry[1]), entry[2]) >= (len(best[1]), best[2])):
                        best = entry
                at = at.get(segment)
        return best


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", url_col: str = "url", max_trie: int = MAX_TRIE) -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict. Up to max_trie entries go to the
    executors as a trie; more are joined by their host and path, with every suffix and prefix of the url's."""
    rules = list({(h.translate(_UPPER), p): (v, h.translate(_UPPER), p) for v, h, p in rules}.values())
    if len(rules) > max_trie:
        return _joined(pages, rules, default, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    base = common.without(pages, _OUT.fieldNames())
    out = T.StructType(base.schema.fields + _OUT.fields)

    def run(batches):
        import pyarrow as pa

        trie = shared.value
        for batch in common.pieces(batches):
            rows = []
            for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
                host, path = split_url(url)
                hit = trie.find(host, path)
                rows.append((host, path, hit and hit[1], hit[0] if hit else default))
            made = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in out.fields])

    return base.mapInArrow(run, out)


def _joined(pages: DataFrame, rules: list, default: str, url_col: str) -> DataFrame:
    """As filter_urls, for more entries than a trie may hold: each distinct (host, path) is joined with
    the entries on host suffix and the lengths that paths of entries have."""
    spark = pages.sparkSession
    base = common.without(pages, _OUT.fieldNames())
    at = F.expr(f"instr(`{url_col}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^(?s)([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^(?s)[^/?#]*([^?#]*)", 1)
    base = base.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    entries = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    sizes = F.lit(sorted({len(p) for _, _, p in rules}))
    labels = F.split("host", r"\.")
    keys = base.select("host", "path").distinct()
    keys = keys.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("rule_host"))
    keys = keys.select("*", F.explode(F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))).alias("rule_path"))
    best = keys.join(entries, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.concat("rule_host", "rule_path").alias("rule")), F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"))).alias("hit"))
    return base.join(best, ["host", "path"], "left").select(*[c for c in base.columns], F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
