"""Secret scans over a trigram inverted index (operator 8).

Each rule's regular expression is turned into a Boolean query of trigrams that every match
must hold. An index is a Parquet table of postings: for a segment of documents and each trigram
in it, which of the segment's texts have it. A rule's candidates come from intersecting and
joining stored postings, without any text, and only they are verified with the expression
itself. A rule from which no mandatory trigram follows (a bare character class, say) scans all.

Texts are known to the index by their hash, so equal texts are indexed and found alike, and an
index serves any rules. Trigrams are of bytes, ASCII letters in lower case on both sides; that
only adds candidates. Texts are never shuffled, but for those that may be candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.names import fresh
from quillmill.llm.common import by_arrow, discard, materialize, scratch_path, slices, split_by, texts_of

#: Strings that are followed through a sequence at most; beyond, the sequence is cut.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, dropped if ``group`` is under ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, in the order of kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Rules that the scan adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: True, a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple[str, tuple["Query", ...]]


def _small(c: str) -> str:
    return c.lower() if c.isascii() else c


def _join(kind: str, parts: list[Query]) -> Query:
    stop = kind == "or"
    if any(p is stop for p in parts):
        return stop
    rest = tuple(dict.fromkeys(p for p in parts if p is not True and p is not False))
    return (not stop) if not rest else rest[0] if len(rest) == 1 else (kind, rest)


def _of_strings(strings: set[str]) -> Query:
    """One of the strings is there."""
    coded = [s.encode("utf-8", "replace") for s in sorted(strings)]
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in coded])


def _exact(node: tuple) -> set[str] | None:
    """All strings that a node can match, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {_small(chr(value))}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= MOST:
        return {_small(chr(v)) for _, v in value}
    if kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
        points = [c for k, v in value for c in ([v] if k is op.LITERAL else range(v[0], min(v[1], v[0] + MOST) + 1))]
        return {_small(chr(c)) for c in points} if len(points) <= 8 else None
    if kind is op.SUBPATTERN:
        return _product([_exact(x) for x in value[3]])
    if kind is op.BRANCH:
        branches = [_product([_exact(x) for x in b]) for b in value[1]]
        return None if None in branches or len(found := set().union(*branches)) > MOST else found
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 4 and (own := _product([_exact(x) for x in value[2]])) is not None:
        counts = [_product([own] * n) for n in range(value[0], value[1] + 1)]
        return None if None in counts or len(found := set().union(*counts)) > MOST else found
    return {""} if kind is op.AT else None


def _product(parts: list[set[str] | None]) -> set[str] | None:
    out = {""}
    for part in parts:
        if part is None or len(out) * len(part) > MOST:
            return None
        out = {a + b for a in out for b in part}
    return out


def _of_sequence(nodes: list[tuple]) -> Query:
    found: list[Query] = []
    run = {""}
    for node in nodes:
        exact = _exact(node)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        found.append(_of_strings(run))
        run = {""} if exact is None else exact
        if exact is None:
            kind, value = node
            if kind is op.SUBPATTERN:
                found.append(_of_sequence(list(value[3])))
            elif kind is op.BRANCH:
                found.append(_join("or", [_of_sequence(list(b)) for b in value[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0]:
                found.append(_of_sequence(list(value[2])))
    found.append(_of_strings(run))
    return _join("and", found)


def trigram_query(pattern: str) -> Query:
    """A query of lower-case trigrams that holds for every text with a match; True if there is none."""
    return _of_sequence(list(parser.parse(pattern)))


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if isinstance(query, bool) else set().union(*map(trigrams, query[1]))


def number_of(trigram: bytes) -> int:
    return trigram[0] | trigram[1] << 8 | trigram[2] << 16


def postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of the texts (fewer than 65,536), where each one's places begin, and the places: text numbers."""
    data = [t.encode("utf-8", "replace").lower() for t in texts]
    joined = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    if len(joined) < 3:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(d) for d in data])
    keys = joined[:-2] << np.uint64(16) | joined[1:-1] << np.uint64(24) | joined[2:] << np.uint64(32)
    owner = np.repeat(np.arange(len(data), dtype=np.uint64), lengths)
    keys = np.unique((keys | owner[:-2])[owner[:-2] == owner[2:]])
    numbers = (keys >> np.uint64(16)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]][: len(numbers)])
    return numbers[starts], np.r_[starts, len(keys)], (keys & np.uint64(0xFFFF)).astype(np.int64)


def holds(query: Query, found: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """For each of ``n`` texts, if the query holds by the postings; a trigram that is not there has none."""
    if isinstance(query, bool):
        return np.full(n, query)
    if isinstance(query, bytes):
        return found.get(query, np.zeros(n, bool))
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce([holds(q, found, n) for q in query[1]])


#: Bytes of text in a segment, and the trigram number under which its texts' hashes are stored.
SEGMENT, HASHES = 1_000_000, -1
POSTINGS = "segment long, trigram int, dense boolean, texts binary"


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def write_index(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Write the index of all texts to ``path``: postings as lists of 16-bit places, or bit sets where these are smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SEGMENT) if batch.num_rows else ():
                n, number = part.num_rows, number + 1
                trigram, cuts, places = postings(texts_of(part.column(1)))
                sizes = np.diff(cuts)
                dense = sizes * 16 > n
                own = np.repeat(dense, sizes)
                lists, ends = places[~own].astype("<u2"), np.r_[0, np.cumsum(sizes[~dense])] * 2
                bits = np.zeros((int(dense.sum()), n), bool)
                bits[np.repeat(np.arange(len(bits)), sizes[dense]), places[own]] = True
                packed = np.packbits(bits, axis=1, bitorder="little")
                texts = [
                    pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(lists.tobytes())]),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                ]
                numbers = np.r_[trigram[~dense], trigram[dense], HASHES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(numbers), number)), pa.array(numbers, pa.int32()), pa.array(np.r_[np.sort(dense), False]), pa.concat_arrays(texts)], ["segment", "trigram", "dense", "texts"]
                )

    hashed = df.select(text_hash(text_col).alias("of_text"), F.col(text_col).alias("text"))
    hashed.mapInArrow(run, POSTINGS).sortWithinPartitions("trigram").write.parquet(path)


def candidates(spark: SparkSession, index: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(of_text, rules): texts that may match, by hash, with the set of rules as bits; from the postings alone."""
    queries = {1 << k: q for k, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not True}
    wanted = {number_of(t): t for t in set().union(*map(trigrams, queries.values()))}

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        for own in batch.column(0).to_pylist():
            own = {p["trigram"]: p for p in own}
            texts = np.frombuffer(own.pop(HASHES)["texts"], "<i8")
            n, found = len(texts), {}
            for number, p in own.items():
                if p["dense"]:
                    found[wanted[number]] = np.unpackbits(np.frombuffer(p["texts"], np.uint8), bitorder="little")[:n].astype(bool)
                else:
                    found[wanted[number]] = np.zeros(n, bool)
                    found[wanted[number]][np.frombuffer(p["texts"], "<u2")] = True
            masks = sum((holds(q, found, n).astype(np.int64) * bit for bit, q in queries.items()), np.zeros(n, np.int64))
            yield {"of_text": pa.array(texts[masks > 0]), "rules": pa.array(masks[masks > 0])}

    stored = spark.read.schema(POSTINGS).parquet(index).filter(F.col("trigram").isin(HASHES, *wanted))
    by_segment = stored.groupBy("segment").agg(F.collect_list(F.struct("trigram", "dense", "texts")).alias("own")).select("own")  # a list for each trigram of the rules
    return by_arrow(by_segment, "of_text long, rules long", run).groupBy("of_text").agg(F.bit_or("rules").alias("rules"))


def with_candidates(df: DataFrame, text_col: str, rules: tuple[Rule, ...], index: str | None) -> DataFrame:
    """The columns of ``df`` and, last, the rules by the index as bits; without an index one is written for this scan."""
    spark = df.sparkSession
    path = index or scratch_path(spark, "trigrams")
    if index is None:
        write_index(df, path, text_col)
    found = materialize(candidates(spark, path, rules), "secret-candidates")
    if index is None:
        discard(spark, path)
    of_text, own = (fresh(df, x) for x in ("of_text", "own_hash"))
    maybe, surely = split_by(df, text_hash(text_col), found.select(F.col("of_text").alias("key")))
    named = found.toDF(of_text, rule_set := fresh(df, "rule_set"))
    joined = maybe.withColumn(own, text_hash(text_col)).join(named, F.col(own) == F.col(of_text), "left").select(*[f"`{c}`" for c in df.columns], F.coalesce(rule_set, F.lit(0)).alias(rule_set))
    return joined.unionByName(surely.withColumn(rule_set, F.lit(0).cast("long")))


def find_spans(texts: list[str], rules: tuple[Rule, ...], allowed: list[int] | None = None) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of each text, leftmost and non-overlapping per rule, by start, then rule.

    ``allowed`` has the rules to verify in each text as bits, all by default; rules without a trigram are always.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(rules):
        expression, everywhere = rule.compiled(), allowed is None or trigram_query(rule.pattern) is True
        if rule.group == 0 and rule.pattern.endswith("+") and rule.least and len(parser.parse(rule.pattern)) == 1:
            expression = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", expression.flags)  # a run of one class: short runs need no match
        for i, text in enumerate(texts):
            if everywhere or allowed[i] >> k & 1:
                found[i] += [(m.start(), k, m.end()) for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [[(rules[k].kind, a, b) for a, k, b in sorted(x)] for x in found]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED, index: str | None = None) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of each row. Null and empty texts have none; rows are independent.

    ``index`` is the path of an index of these texts; texts that it lacks are only searched by the rules that scan all.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        spans = find_spans(texts_of(batch.column(1)), rules, batch.column(2).to_pylist())
        yield {id_col: batch.column(0), "spans": pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], span)}

    return by_arrow(with_candidates(df.select(f"`{id_col}`", f"`{text_col}`"), text_col, rules, index), schema, run, text=1)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: str | None = None) -> DataFrame:
    """(id, n_<kind> of the base rules, base_sha256, spans) of each row."""
    kinds = [r.kind for r in BASE]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in kinds)}, base_sha256 string, spans string"

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        found = find_spans(texts_of(batch.column(1)), BASE + ADDED, batch.column(2).to_pylist())
        columns: dict[str, object] = {id_col: batch.column(0)}
        for kind in kinds:
            columns[f"n_{kind}"] = pa.array([sum(k == kind for k, _, _ in x) for x in found], pa.int64())
        texts = [[f"{k}:{a}:{b}" for k, a, b in x] for x in found]
        base = [",".join([s for s, (k, _, _) in zip(t, x) if k in kinds]) for t, x in zip(texts, found)]
        yield columns | {"base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), "spans": pa.array([",".join(t) for t in texts], pa.string())}

    return by_arrow(with_candidates(df.select(f"`{id_col}`", f"`{text_col}`"), text_col, BASE + ADDED, index), schema, run, text=1)


def redact(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED, mask: str = "[secret]", index: str | None = None) -> DataFrame:
    """``df`` with each secret replaced by ``mask``; overlapping spans give one. Null texts stay null."""
    names, schema = df.columns, df.schema

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        texts = batch.column(names.index(text_col)).to_pylist()
        out = []
        for text, spans in zip(texts, find_spans([t or "" for t in texts], rules, batch.column(len(names)).to_pylist())):
            parts, at = [], 0
            for _, a, b in spans:
                if a >= at:
                    parts += [text[at:a], mask]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]) if spans else text)
        yield {c: pa.array(out, pa.string()) if c == text_col else batch.column(i) for i, c in enumerate(names)}

    return by_arrow(with_candidates(df, text_col, rules, index), schema, run, text=names.index(text_col))
