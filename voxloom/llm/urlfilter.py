"""URL filters: allow and block entries in a trie over reversed host labels and then path segments.

An entry is ``host/path``; it fits its host, all subdomains of it, and every path that starts with its own. Of the entries that fit,
the one with the longest host wins, then the one with the longest path; of one entry given twice, block wins. The trie is
broadcast only where the entries' counted number and bytes are within a bound. Beyond it, entries are joined by what a trie's nodes
stand for: a host suffix and whole path segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.llm.common import read

#: The most entries, and bytes of them, that are broadcast as a trie.
MAX_ENTRIES, MAX_BYTES = 200_000, 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Node:
    """``below``: nodes by label or segment; ``ends``: entries that end here, a host's or a path's, longest remainder first."""

    __slots__ = ("below", "ends", "paths")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        self.paths: Node | None = None
        self.ends: list[tuple[str, str, str]] = []


class Trie:
    def __init__(self, entries: Iterable[tuple[str, str]]) -> None:
        self.root = Node()
        for entry, verdict in entries:
            host, slash, rest = entry.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.below.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, part = (slash + rest).split("/")
            for segment in whole:
                node = node.below.setdefault(segment, Node())
            node.ends.append((part, entry, verdict))
            node.ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The entry that decides and its verdict."""
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths is not None:
                hosts.append(node.paths)
        segments = path.split("/") if hosts else []
        for top in reversed(hosts):
            best, at = None, top
            for segment in segments:
                best = next((e for e in at.ends if segment.startswith(e[0])), best)
                at = at.below.get(segment)
                if at is None:
                    break
            if best:
                return best[1], best[2]
        return None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _entries(spark: SparkSession, entries: DataFrame | Iterable[tuple[str, str]]) -> DataFrame:
    """``entry, verdict``, each entry once; hosts in lower case."""
    df = entries if isinstance(entries, DataFrame) else spark.createDataFrame(list(entries), "entry string, verdict string")
    df = df.select(df["entry"].alias("raw"), df["verdict"].alias("verdict")).where("raw IS NOT NULL AND substring_index(raw, '/', 1) <> '' AND verdict IN ('allow', 'block')")
    host = F.substring_index("raw", "/", 1)
    return df.select(F.concat(F.translate(host, _UPPER, _LOWER), F.expr("substring(raw, length(substring_index(raw, '/', 1)) + 1)")).alias("entry"), "verdict").groupBy("entry").agg(F.max("verdict").alias("verdict"))


def _walked(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` with what the broadcast trie says; each task builds it once."""
    sent = rows.sparkSession.sparkContext.broadcast([tuple(e) for e in entries.collect()])

    @F.arrow_udf(returnType="rule string, verdict string")
    def walk(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = Trie(sent.value)
        for host, path in batches:
            found = [trie.find(h, p) or (None, None) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["rule", "verdict"])

    return rows.withColumn("found", walk("host", "path"))


def _joined(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` with what a shuffled join says: distinct hosts and paths meet the entries at every host suffix and whole path prefix
    that is no deeper than the deepest entry."""
    path = F.expr("substring(entry, length(substring_index(entry, '/', 1)) + 1)")
    nodes = entries.select("entry", "verdict", F.substring_index("entry", "/", 1).alias("top"), path.alias("path")).select(
        "entry", "verdict", F.struct("top", F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)))").alias("whole")).alias("node"), F.length("top").alias("h"), F.length("path").alias("p"), "path"
    )
    urls = rows.select("host", "path").distinct()
    labels, segments = F.split("host", "[.]"), F.split("path", "/")
    deep, long = (n or 0 for n in entries.agg(F.max(F.size(F.split(F.substring_index("entry", "/", 1), "[.]"))), F.max(F.size(F.split(path, "/")))).first())
    tops = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deep))), lambda k: F.concat_ws(".", F.slice(labels, -k, k)))
    wholes = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(long)) - 1), lambda k: F.concat_ws("", F.transform(F.slice(segments, 1, k), lambda s: F.concat(s, F.lit("/")))))
    at = urls.select("host", F.col("path").alias("own"), F.explode(tops).alias("top"), wholes.alias("wholes")).select("host", "own", "top", F.explode("wholes").alias("whole")).select("host", "own", F.struct("top", "whole").alias("node"))
    fit = at.join(nodes, "node").where(F.startswith("own", "path"))
    best = fit.groupBy("host", "own").agg(F.max_by(F.struct(F.col("entry").alias("rule"), "verdict"), F.struct("h", "p")).alias("found"))
    return rows.join(best.withColumnRenamed("own", "path"), ["host", "path"], "left")


def with_verdicts(pages: DataFrame, entries: DataFrame | Iterable[tuple[str, str]], default: str = "allow", more: DataFrame | Iterable[tuple[str, str]] | None = None, url_col: str = "url", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``row, host, path, rule, verdict`` per row of ``pages``; ``row`` is the whole row, so that no column's name can clash.

    entries: (``host/path``, ``allow`` or ``block``); rule: the one that decides, null where none fits. Such urls get the verdict of
    ``more``, a second list that is asked only then, else ``default``. A null url, or one without ``://``, has an empty host and path.
    Entries that are null, have no host or another verdict are left out; hosts are compared in lower case (A-Z). Repeated rows
    are judged each; an empty table gives no rows, an empty list the default.
    """
    host, path = host_and_path(pages[url_col])
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    for name, listed in (("first", entries), ("second", more)):
        if listed is None:
            rows = rows.withColumn(name, F.lit(None).cast("struct<rule: string, verdict: string>"))
            continue
        known = _entries(pages.sparkSession, listed)
        n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()
        if n == 0:
            rows = rows.withColumn(name, F.lit(None).cast("struct<rule: string, verdict: string>"))
            continue
        rows = (_walked if n <= max_entries and size <= MAX_BYTES else _joined)(rows, known).withColumnRenamed("found", name)
    return rows.select("row", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", "second.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, entries: DataFrame | Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """``id_col, host, path, rule, verdict`` per row of ``pages``; see :func:`with_verdicts`. A null identifier stays null."""
    judged = with_verdicts(pages.select(id_col, url_col), entries, url_col=url_col, **options)
    return judged.select(F.col("row")[id_col].alias(id_col), "host", "path", "rule", "verdict")


def filter_urls(pages: DataFrame, entries: DataFrame | Iterable[tuple[str, str]], **options) -> DataFrame:
    """The rows of ``pages`` whose url is allowed, every column kept whatever its name; see :func:`with_verdicts`."""
    return with_verdicts(pages, entries, **options).where("verdict = 'allow'").select("row.*")


#: The rules of the query, fixed by its contract.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Sites that the method blocks where no rule fits.
SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED = tuple((f"{site}.example.{top}", "block") for site in SITES for top in ("net", "org"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), RULES, more=BLOCKED)


SQL = {
    "op13_url_filter": r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT l.*, (SELECT arg_max({'rule': h || p, 'verdict': v}, 1000 * length(h) + length(p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS f FROM l)
SELECT page_id, host, path, f.rule AS rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(host, '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(net|org)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
}
