"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one Shift-And state of several 64-bit words.
Each bit is a position of a pattern; a byte step shifts every pattern at once,
and wildcard positions keep themselves alive on the bytes they accept. A batch
of URLs is advanced together, so one numpy step moves every pattern of every
URL by one byte.

Pattern syntax, matched against the whole of "." + host + path:

* ``*``  any bytes but "/" (stays inside the host or one path segment)
* ``**`` any bytes
* anything else stands for itself
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, table

_U = np.uint64
BATCH = 4096


@dataclass(frozen=True)
class Rule:
    """verdict is 'block' or 'allow'; ranked rules carry the name that is reported and win by its length."""

    pattern: str
    verdict: str
    name: str | None = None


def host_rule(verdict: str, name: str) -> Rule:
    """host/path: the host and its subdomains, and paths that start with the rule's."""
    host, _, path = name.partition("/")
    return Rule(f"*.{host}/{path}**", verdict, name)


# The rules that the contract states.
BASE_RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)
# This operator's own glob rules; they decide only where no base rule fits.
GLOB_RULES = (
    Rule("**spam-farm.**", "block"),
    Rule("**cheap-pills.**", "block"),
    Rule("**casino**", "block"),
    Rule("**/wp-login.php**", "block"),
    Rule("**/login/**", "block"),
    Rule("**.exe", "block"),
    Rule("*.ads.**", "block"),
)


class ShiftAnd:
    """Patterns compiled to multiword masks. match() tells for each text which patterns fit it whole."""

    def __init__(self, patterns: Sequence[str]):
        bits: list[tuple[str, int]] = []  # kind or "lit", byte
        starts, ends = [], []
        for p in patterns:
            raw, i, begin = p.encode(), 0, len(bits)
            bits.append(("start", 0))  # alive before the first byte only
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    bits.append(("any", 0))
                    i += 2
                elif raw[i] == 42:
                    bits.append(("seg", 0))
                    i += 1
                else:
                    bits.append(("lit", raw[i]))
                    i += 1
            starts.append(begin)
            ends.append(len(bits) - 1)
        n = max(1, len(bits))
        self.words = (n + 63) // 64
        mask = lambda where: self._pack([b in where for b in range(n)])
        lit = [[b for b, (k, c) in enumerate(bits) if k == "lit" and c == v] for v in range(256)]
        self.step = np.stack([mask(set(x)) for x in lit])
        every = {b for b, (k, _) in enumerate(bits) if k == "any"}
        segment = {b for b, (k, _) in enumerate(bits) if k == "seg"}
        self.stay = np.stack([mask(every if c == 47 else every | segment) for c in range(256)])
        self.wild = mask(every | segment)
        self.start = mask(set(starts))
        self.ends = ends
        longest = run = 0
        for k, _ in bits:
            run = run + 1 if k in ("any", "seg") else 0
            longest = max(longest, run)
        self.hops = longest

    def _pack(self, flags: list[bool]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b, f in enumerate(flags):
            if f:
                out[b >> 6] |= _U(1) << _U(b & 63)
        return out

    @staticmethod
    def _shift(d: np.ndarray) -> np.ndarray:
        out = d << _U(1)
        out[:, 1:] |= d[:, :-1] >> _U(63)
        return out

    def _close(self, d: np.ndarray) -> np.ndarray:
        """A wildcard may be empty: the position before it enters it without a byte."""
        for _ in range(self.hops):
            d = d | (self._shift(d) & self.wild)
        return d

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean row for each text, a column for each pattern."""
        n = len(texts)
        size = np.fromiter((len(t) for t in texts), np.int64, n)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        d = self._close(np.repeat(self.start[None, :], n, 0))
        # Texts still running at each step; none is copied or padded.
        live = np.searchsorted(-size, -np.arange(int(size[0]) if n else 0), "left")
        for i, k in enumerate(live.tolist()):
            c = data[begin[:k] + i]
            d[:k] = self._close((self._shift(d[:k]) & self.step[c]) | (d[:k] & self.stay[c]))
        out = np.zeros((n, len(self.ends)), bool)
        for k, b in enumerate(self.ends):
            out[order, k] = (d[:, b >> 6] >> _U(b & 63)) & _U(1) != 0
        return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without "://"."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", base: Sequence[Rule] = BASE_RULES, globs: Sequence[Rule] = GLOB_RULES, default: str = "allow") -> DataFrame:
    """Judge every URL: host, path, rule (the longest base rule that fits, else null), verdict, pattern (what decided, else null).

    Without a base rule the glob rules decide; a block outweighs an allow, and without any the verdict is `default`.
    A null URL, or one without "://", has an empty host and path, fits no base rule and gets `default`.
    Every row gives one row, repeated ids included; an empty table gives none; other columns are ignored.
    """
    ranked = sorted(base, key=lambda r: -len(r.name or ""))
    own = sorted(globs, key=lambda r: r.verdict != "block")
    rules = [*ranked, *own]
    machine = ShiftAnd([r.pattern for r in rules])
    kind = df.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, host string, path string, rule string, verdict string, pattern string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                hit = machine.match([("." + h + p).encode() for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
                first = np.where(hit.any(1), hit.argmax(1), -1)
                won = [rules[k] if k >= 0 else None for k in first]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(k) for k in range(3)),
                        pa.array([r and r.name for r in won], pa.string()),
                        pa.array([r.verdict if r else default for r in won], pa.string()),
                        pa.array([r and r.pattern for r in won], pa.string()),
                    ],
                    names=[id_col, "host", "path", "rule", "verdict", "pattern"],
                )

    host, path = split_url(F.col(f"`{url_col}`"))
    return arrow_map(df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path")), run, schema)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages; what filter_urls says of nulls, long and repeated urls and empty tables holds."""
    out = filter_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.col("pattern").alias("matched"))


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/]*((?s:.*))$', 1) AS path FROM c),
r AS (
  SELECT page_id, host, path, '.' || host || path AS canon,
         CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p),
g AS (
  SELECT *, CASE WHEN rule = 'example.net/en/' THEN '*.example.net/en/**' WHEN rule = 'example.com/de/' THEN '*.example.com/de/**'
                 WHEN rule = 'org/fr/' THEN '*.org/fr/**' WHEN rule = 'net/' THEN '*.net/**'
                 WHEN contains(canon, 'spam-farm.') THEN '**spam-farm.**' WHEN contains(canon, 'cheap-pills.') THEN '**cheap-pills.**'
                 WHEN contains(canon, 'casino') THEN '**casino**' WHEN contains(canon, '/wp-login.php') THEN '**/wp-login.php**'
                 WHEN contains(canon, '/login/') THEN '**/login/**' WHEN ends_with(canon, '.exe') THEN '**.exe'
                 WHEN regexp_matches(canon, '^[^/]*\\.ads\\.') THEN '*.ads.**' END AS matched
  FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN matched IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, matched
FROM g
"""
