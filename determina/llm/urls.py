"""URL filters on a sorted array of digests.

Rules and blocked hosts are kept as 64-bit xxhash keys, sorted, with the full strings beside them.
The array is written to the shared folder and shipped as a file; tasks map it into memory, probe
all candidates of a batch by one binary search and compare the full string of every hit.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from determina.llm.shared import fresh_path

#: Rules as (verdict, host, path).
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
#: Hosts blocked with all their subdomains where no rule decides.
BLOCKED = ["casino-win.example.com", "ads-track.example.com", "free-bets.example.com", "spam-farm.example.com", "cheap-pills.example.com", "adult-x.example.net"]
VERDICTS = ["allow", "block"]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host`` and ``path``: empty where the url is null or has no ``://``."""
    cut = F.instr(F.col(url), "://")
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    has = F.coalesce(cut > 0, F.lit(False))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.when(has, lower).otherwise("")).withColumn("path", F.when(has, path).otherwise(""))


def digest_array(spark: SparkSession, entries: list[tuple[str, int]], largest: int = 1 << 28) -> str:
    """Ship (string, value) entries as one file; returns its name for ``SparkFiles``.

    Layout: count, then ascending keys, values and string ends (all 8 bytes), then the strings. The
    list is the caller's and of a size checked against ``largest`` bytes; a repeated string keeps
    its first value.
    """
    distinct = dict(reversed(entries))
    strings = [s.encode() for s in distinct]
    import xxhash

    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = [strings[i] for i in order]
    values = np.array(list(distinct.values()), np.int64)[order]
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
    body = np.int64(len(keys)).tobytes() + keys[order].tobytes() + values.tobytes() + ends.tobytes() + b"".join(strings)
    if len(body) > largest:
        raise ValueError(f"{len(body)} bytes of rules; split the list or raise the limit of {largest}")
    path = fresh_path(spark, f"digests-{uuid.uuid4().hex}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(body)
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


class Digests:
    """The shipped array, mapped into memory."""

    def __init__(self, path: str) -> None:
        n = int(np.fromfile(path, np.int64, 1)[0])
        parts = [np.memmap(path, t, "r", 8 + 8 * n * k, (n,)) if n else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int64, np.int64))]
        self.keys, self.values, self.ends = parts
        size = int(self.ends[-1]) if n else 0
        self.strings = np.memmap(path, np.uint8, "r", 8 + 24 * n, (size,)) if size else np.zeros(0, np.uint8)

    def find(self, texts: list[bytes], hash_of) -> np.ndarray:
        """Entry of each text, or -1; keys that collide are told apart by their strings."""
        keys = np.array([hash_of(t) for t in texts], np.uint64)
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1, np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == keys) if len(self.keys) else []):
            k = at[i]
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.strings[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes() == texts[i]:
                    found[i] = k
                    break
                k += 1
        return found


def _judge_batches(name: str, lengths: list[int]):
    """Task code: (row, host, path) to (row, host, path, rule, verdict)."""

    def run(batches):
        import xxhash

        digests = Digests(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            texts, owner, is_rule = [], [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                starts = [0, *(k + 1 for k, c in enumerate(host) if c == ".")] if host else []
                for tail in (host[k:] for k in starts):
                    texts.append(f"={tail}")
                    is_rule.append(False)
                    texts += [tail + path[:n] for n in lengths if n <= len(path)]
                    is_rule += [True] * sum(n <= len(path) for n in lengths)
                owner += [i] * (len(texts) - len(owner))
            texts = [t.encode() for t in texts]
            rule, verdict = [None] * len(hosts), ["allow"] * len(hosts)
            found = digests.find(texts, xxhash.xxh64_intdigest)
            for k in np.flatnonzero(found >= 0):
                i, text, value = owner[k], texts[k], VERDICTS[digests.values[found[k]]]
                if not is_rule[k]:
                    if rule[i] is None:
                        verdict[i] = value
                elif rule[i] is None or len(text) > len(rule[i]):
                    rule[i], verdict[i] = text, value
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("host"), batch.column("path"), pa.array([r and r.decode() for r in rule], pa.string()), pa.array(verdict, pa.string())],
                ["row", "host", "path", "rule", "verdict"],
            )

    return run


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, blocked: list[str] = BLOCKED) -> DataFrame:
    """(row, host, path, rule, verdict) of every row; ``row`` holds all columns of ``pages``.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with
    its path; the longest fitting one wins, as text of host and path. Without a fitting rule a host
    below a blocked one is blocked, and all else allowed. Null urls and urls without ``://`` have an
    empty host, fit no rule and are allowed. Repeated rows are judged each; an empty table is empty.
    """
    entries = [(h + p, VERDICTS.index(v)) for v, h, p in rules] + [(f"={h}", 1) for h in blocked]
    name = digest_array(pages.sparkSession, entries)
    parts = with_parts(pages.select(F.struct("*").alias("row"), F.col(url).alias("url")))
    parts = parts.select("row", "host", "path")
    schema = StructType(parts.schema.fields + StructType.fromDDL("rule string, verdict string").fields)
    return parts.mapInArrow(_judge_batches(name, sorted({len(p) for _, _, p in rules})), schema)
