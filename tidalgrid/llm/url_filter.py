"""URL filters: glob rules packed into multiword Shift-And masks that run over each canonical URL at once.

A canonical URL is ``.host``, one boundary symbol, and the path, so a rule's ``*`` never crosses from host to path.
Host rules cover the host and all its subdomains; of the rules that fit, the longest wins, then the earliest. URLs that
no rule fits are judged by the default globs, which look at host and path alike.

Null urls and urls without ``://`` have an empty host and path and are allowed. Rows are judged one by one; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import small_batches

#: Fixed values: (verdict, host, path) of the site rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over host and path that block what no site rule judges.
DEFAULT_BLOCK = ("*spam*", "*casino*", "*cheap-pills*", "*.exe", "*/ads/*")
BOUNDARY = 256


class ShiftAnd:
    """Bit-parallel automaton of all globs; ``*`` is a self loop, ``?`` any one symbol, masks spread over 64-bit words.

    A glob is a list of symbols: ints below 257, ``"*"`` or ``"?"``.
    """

    def __init__(self, globs: list[list]):
        bits, self.spans, loops, starts, free, any_at = 0, [], [], [], [], []
        symbols: list[tuple[int, int]] = []
        self.empty = []
        for g in globs:
            first, lead = bits, False
            for x in g:
                if x == "*":
                    if bits == first:
                        lead = True
                    else:
                        loops.append(bits - 1)
                else:
                    (any_at.append(bits) if x == "?" else symbols.append((x, bits)))
                    bits += 1
            self.empty.append((bits == first, lead))
            if bits > first:
                (free if lead else starts).append(first)
            self.spans.append((first, bits - 1, bool(g) and g[-1] == "*"))
        self.words = max(1, -(-bits // 64))
        self.mask = np.zeros((257, self.words), np.uint64)
        for x, b in symbols:
            self.mask[x, b // 64] |= np.uint64(1 << (b % 64))
        for b in any_at:
            self.mask[:, b // 64] |= np.uint64(1 << (b % 64))
        self.loop, self.start, self.free = (self._row(b) for b in (loops, starts, free))
        self.firsts = self._row([a for a, b, _ in self.spans if b >= a])
        self.sticky = self._row([b for a, b, tail in self.spans if tail and b >= a])

    def _row(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def matches(self, urls: list[list[int]]) -> np.ndarray:
        """For each sequence of symbols and each glob, whether the whole sequence fits."""
        n = len(urls)
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lens = np.array([len(urls[i]) for i in order], np.int64)
        state = np.zeros((n, self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        flat = np.concatenate([np.asarray(urls[i], np.int64) for i in order]) if n and lens.sum() else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]]) if n else lens
        for step in range(int(lens[0]) if n else 0):
            live = int(np.searchsorted(-lens, -step, "left"))
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= ~self.firsts
            moved |= self.free
            if step == 0:
                moved |= self.start
            state[:live] = (moved & self.mask[flat[at[:live] + step]]) | (d & self.loop) | (d & self.sticky)
        out = np.zeros((n, len(self.spans)), bool)
        for k, (a, b, _) in enumerate(self.spans):
            if b < a:
                out[order, k] = True if self.empty[k][1] else lens == 0
            else:
                out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & one == one
        return out


def host_glob(host: str, path: str) -> list:
    return ["*", *f".{host}".encode(), BOUNDARY, *path.encode(), "*"]


def text_glob(glob: str) -> list:
    return [x if x in "*?" else ord(x) for x in glob] if glob.isascii() else [y for x in glob for y in ([x] if x in "*?" else x.encode())]


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    head = rest[:cut]
    slash = head.find("/")
    host, path = (head, "") if slash < 0 else (head[:slash], head[slash:])
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def judge_urls(pages: DataFrame, url: str = "url", rules: tuple = RULES, default_block: tuple = DEFAULT_BLOCK) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced."""
    small_batches(pages.sparkSession)
    added = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    keep = [f for f in pages.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType(keep + added)
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = [f"{h}{p}" for _, h, p in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites = ShiftAnd([host_glob(h, p) for _, h, p in ranked])
        rest = ShiftAnd([text_glob(g) for g in default_block])
        for batch in batches:
            parts = [canonical(u) for u in batch.column(batch.schema.get_field_index(url)).to_pylist()]
            fits = sites.matches([[*f".{h}".encode(), BOUNDARY, *p.encode()] if h or p else [] for h, p in parts])
            bad = rest.matches([list((h + p).encode()) for h, p in parts]).any(axis=1) if default_block else np.zeros(len(parts), bool)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist() if ranked else [-1] * len(parts)
            rule = [names[b] if b >= 0 else None for b in best]
            verdict = [ranked[b][0] if b >= 0 else "block" if x else "allow" for b, x in zip(best, bad.tolist(), strict=True)]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            cols = [pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], rule, verdict)]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=schema.fieldNames())

    return pages.mapInArrow(run, schema)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
       ELSE CASE WHEN contains(host || path, 'spam') OR contains(host || path, 'casino') OR contains(host || path, 'cheap-pills') OR ends_with(host || path, '.exe') OR contains(host || path, '/ads/') THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
