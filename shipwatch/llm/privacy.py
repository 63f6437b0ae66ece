"""Information-theoretic sanitisation of personal data.

Protected entities are the values that the base patterns find (e-mail, IP,
card and phone). A term discloses an entity as far as it narrows down who is
meant: the information that term t gives on entity c is the pointwise mutual
information ``log2(P(c | t) / P(c))``, and the entity's own information is
``-log2 P(c)``, with document frequencies over the whole corpus. ``P(c | t)`` is
taken at the lower end of its 90 % score interval, so one text is weak evidence
in a corpus of any size. Where at most ``RESIDUAL`` bits about some entity remain
and the term gives at least the share ``DISCLOSURE`` of its information, the term
is generalised at all its places in every text that holds it, near the entity,
far from it or without it. Words of the general vocabulary stand mostly in texts
without the entity, and rare words in one text only: both stay. The base spans
are always removed.

Copies count once. Equal texts are one text; texts with a common minhash over
runs of five words are one kind, and m texts weigh as evidence what their
effective number of kinds does, ``m ** 2 / sum(texts of a kind ** 2)``.

Passes: (1) a map over all texts finds base spans, entities and minhashes; (2) a
map gives (term, text key) for the texts whose entity stands in texts of several
kinds (no other can disclose), joined with the entities by text key; terms that these
texts alone show to stand mostly elsewhere are done; (3) a map counts the texts of the terms left, as partial sums, by text key only where a
text has copies; (4) a map with a bit table of fixed size finds places of words
that may be disclosing terms, and a join by term, salted, keeps those that are.
Texts are never shuffled for the report, no count is capped or sampled. Entities
that stand in the same texts are judged once.

Offsets are code points, ends exclusive. Defined cases: null and empty texts
have no data; added spans belong to a text, so rows with a repeated or null
doc_id get those of their own text; extra columns pass; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from shipwatch.llm import batches as B
from shipwatch.llm.store import free_name, settled

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.75
RESIDUAL = 1.0
DEVIATES = 1.2816       # of the normal distribution: one-sided 90 %
SHINGLE = 5
PRINTS = 4
SALTS = 16
COPY_SALTS = 4
TABLE_BITS = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ENTITY = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, text_key long, "
           "base array<struct<kind:int,start:int,end:int>>, entities array<binary>, prints array<long>")
_SPANS = "array<struct<start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the signs before an @ up to the match before it, and a domain with a dot."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL_SIGNS:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers, each at most 255; a longer chain is read four at a time."""
    out = []
    for m in _DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        parts, at = chain.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            start = at + sum(len(p) + 1 for p in parts[:i])
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:].lstrip("0") or 0) <= 255 for p in four):
                out.append((start, start + sum(map(len, four)) + 3))
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(1, a, b) for a, b in addresses(text)]
        out += [(2, a, b) for a, b in cards(text)]
        if "+" in text:
            out += [(3, a, b) for a, b in phones(text)]
    return out


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def entities_of(text: str, base: list[tuple[int, int, int]]) -> list[bytes]:
    return sorted({hashlib.blake2b(f"{kind}:{text[a:b].lower()}".encode(), digest_size=16).digest() for kind, a, b in base})


_FIND_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("text_key", pa.int64()),
    ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
    ("entities", pa.list_(pa.binary())), ("prints", pa.list_(pa.int64()))])


def minhashes(f: _Free) -> np.ndarray:
    """PRINTS minhashes of every text over runs of SHINGLE free words; a text of fewer words has its key."""
    count = np.bincount(f.doc[f.free], minlength=len(f.texts))
    runs = np.maximum(count - SHINGLE + 1, 0)
    window = B.window_hash(f.words.hash[f.free], SHINGLE)
    window = window[B.window_starts(np.concatenate([[0], np.cumsum(count)]), SHINGLE)]
    out = np.repeat(np.array([text_key(t) for t in f.texts], np.int64)[:, None], PRINTS, 1)
    full = np.flatnonzero(runs)
    if len(full):
        at = (np.cumsum(runs) - runs)[full]
        for j in range(PRINTS):
            out[full, j] = B.signed(np.minimum.reduceat(B.mix(window + np.uint64(j)), at))
    return out


def found_data(docs: DataFrame) -> DataFrame:
    """Base spans, entities and (with entities) minhashes of every document, without its text."""
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                rows, texts = [], part.column("text").to_pylist()
                bases = [base_spans(t) for t in texts]
                some = [k for k, base in enumerate(bases) if base]
                prints = dict(zip(some, minhashes(_Free(part.take(pa.array(some)))).tolist())) if some else {}
                for k, (doc, text, base) in enumerate(zip(part.column("doc_id").to_pylist(), texts, bases)):
                    n = [sum(j == kind for j, _, _ in base) for kind in range(len(KINDS))]
                    rows.append((doc, *n, None if text is None else text_key(text),
                                 [{"kind": j, "start": a, "end": b} for j, a, b in base], entities_of(text, base), prints.get(k, [])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows), _FIND_SCHEMA)], schema=_FIND_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(B.released(run), _ENTITY)


class _Free:
    """The words of a slice outside the base spans of their texts."""

    def __init__(self, part: pa.RecordBatch):
        texts = B.texts_of(part.column("text"))
        self.texts = texts.column.to_pylist()
        self.words = B.words_of(texts, B.ALNUM, lower=True)
        self.doc, self.free = self.words.doc(), np.ones(len(self.words.start), bool)
        self.base = [base_spans(t) for t in self.texts]
        self._chars, self._offsets, self._data = None, texts.offsets, texts.data
        for k, base in enumerate(self.base):
            if base:
                x, y = int(self.words.first[k]), int(self.words.first[k + 1])
                start, end = self.places(np.arange(x, y))
                for _, a, b in base:
                    self.free[x + np.searchsorted(end, a, "right"):x + np.searchsorted(start, b, "left")] = False

    def places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last code point (exclusive) of words, in their texts."""
        if self._chars is None:             # code points before each byte of the slice
            self._chars = np.concatenate([[0], np.cumsum((self._data & 0xC0) != 0x80)])
        zero = self._chars[self._offsets[self.doc[w]]]
        return self._chars[self.words.start[w]] - zero, self._chars[self.words.end[w]] - zero


_FLUSH = 1_000_000


def _distinct(term: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, by term."""
    order = np.lexsort((of, term))
    term, of = term[order], of[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
    return term[new], of[new]


def _summed(term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    term, at = np.unique(term, return_inverse=True)
    return term, np.bincount(at, n, len(term)).astype(np.int64)


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bit table."""
    bit = table[((h & np.uint64((1 << TABLE_BITS) - 1)) >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))
    return (bit & np.uint64(1)) > 0


def term_texts(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """Distinct (term, key) of the texts whose key may be in the bit table ``keys``."""
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for part in B.slices(batch):
                texts = part.column("text").to_pylist()
                some = {k: text_key(t) for k, t in enumerate(texts) if t and base_spans(t)}
                held = _in(keys, np.array(list(some.values()), np.int64).view(np.uint64))
                some = {key: k for (k, key), h in zip(some.items(), held) if h and key not in seen}
                if not some:
                    continue
                seen.update(some)
                f = _Free(part.take(pa.array(list(some.values()))))
                term, doc = _distinct(B.signed(f.words.hash[f.free]), f.doc[f.free])
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.array(list(some), np.int64)[doc])], names=["term", "key"])
                if len(seen) > _SEEN:
                    seen.clear()

    return docs.select("text").mapInArrow(B.released(run), "term long, key long").distinct()


def text_counts(docs: DataFrame, terms: np.ndarray, copied: np.ndarray) -> DataFrame:
    """(term, texts): in how many different texts the terms of a bit table stand.

    Texts without a copy are summed per task; only those whose key may be in
    ``copied`` travel by key.
    """
    B.prepare(docs.sparkSession)

    def rows(term: np.ndarray, n: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        keys = pa.nulls(len(term), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([pa.array(term), keys, pa.array(n)], names=["term", "key", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept, more, size, seen = (none, none), [], 0, set()
        for batch in it:
            for part in B.slices(batch):
                f = _Free(part)
                w = _maybe(f, terms)
                if not len(w):
                    continue
                term, doc = _distinct(B.signed(f.words.hash[w]), f.doc[w])
                key = np.zeros(len(f.texts), np.int64)
                for k in np.unique(doc).tolist():
                    key[k] = text_key(f.texts[k])
                twice = _in(copied, key.view(np.uint64))
                new = np.ones(len(key), bool)
                for k in np.flatnonzero(twice).tolist():
                    new[k] = key[k] not in seen
                    seen.add(int(key[k]))
                single, other = ~twice[doc], (twice & new)[doc]
                if other.any():
                    yield rows(term[other], np.ones(int(other.sum()), np.int64), key[doc[other]])
                more.append(_summed(term[single], np.ones(int(single.sum()), np.int64)))
                size += len(more[-1][0])
                if size > _FLUSH:
                    kept, more, size = _summed(*map(np.concatenate, zip(kept, *more))), [], 0
                    if len(kept[0]) > _FLUSH:
                        yield rows(*kept)
                        kept = none, none
                if len(seen) > _SEEN:
                    seen.clear()
        yield rows(*_summed(*map(np.concatenate, zip(kept, *more))))

    return (docs.select("text").mapInArrow(B.released(run), "term long, key long, n long").groupBy("term", "key").agg(F.sum("n").alias("n"))
            .groupBy("term").agg(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(1)).alias("texts")))


def entity_texts(found: DataFrame) -> DataFrame:
    """(key, entity, kind): the different texts of every entity, texts with a common minhash as one kind."""
    texts = (found.where(F.size("entities") > 0).groupBy(F.col("text_key").alias("key"))
             .agg(F.first("entities").alias("entities"), F.first("prints").alias("prints")))
    prints = (texts.select("key", F.posexplode("prints").alias("j", "print"))
              .withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")))
    shared = (prints.groupBy("j", "print").agg(F.count("*").alias("size")).where("size > 1")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    kinds = prints.join(shared, ["j", "print", "salt"]).groupBy("key").agg(F.max(F.struct("size", "j", "print")).alias("most"))
    return texts.join(kinds, "key", "left").select(
        "key", F.explode("entities").alias("entity"), F.when(F.col("most").isNull(), F.col("key")).otherwise(F.xxhash64("most.j", "most.print")).alias("kind"))


def lower_limit(share: Column, n: Column) -> Column:
    """The lower end of the score interval of a share seen in n cases."""
    z2 = DEVIATES ** 2
    return (share + z2 / (2 * n) - DEVIATES * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing(found: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> DataFrame:
    """The terms that leave at most ``residual`` bits of some entity and give at least the share ``disclosure`` of it."""
    spark = docs.sparkSession
    known = found.where("text_key is not null").groupBy("text_key").agg(F.count("*").alias("copies"))
    total = float(max(known.count(), 1))
    holds = settled(entity_texts(found), "privacy-holds")
    # entities that stand in the same texts are alike: one of them is judged, if its texts are of several kinds
    alike = (holds.groupBy("entity").agg(F.count("*").alias("df"), F.expr("bit_xor(key)").alias("x"), F.expr("bit_xor(xxhash64(key))").alias("y"),
                                         (F.min("kind") != F.max("kind")).alias("several")).where("several")
             .groupBy("df", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "df")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    holds = settled(holds.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(alike, ["entity", "salt"]).drop("salt"), "privacy-several")
    keys = bit_table(holds.select(F.col("key").alias("term")))
    if not keys.any():
        return spark.range(0).select(F.col("id").alias("term"))     # made without Python workers

    def telling(limit: Column) -> Column:
        own, left = -F.log2(F.col("df") / F.lit(total)), -F.log2(limit)
        return (own > 0) & (left <= residual) & (own - left >= disclosure * own)

    def judged(rows: DataFrame, counts: DataFrame) -> DataFrame:
        """The (term, entity) that tell enough if the term stands in ``texts`` texts."""
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        share = F.col("both") / F.col("texts")
        return (rows.withColumn("salt", F.pmod(F.xxhash64("entity"), F.lit(SALTS)).cast("int")).join(spread, ["term", "salt"])
                .where(telling(lower_limit(share, F.col("kinds") / share))).select(*rows.columns))

    pairs = settled(term_texts(docs, keys), "privacy-pairs")
    both = (pairs.join(holds, "key").groupBy("term", "entity", "df", "kind").agg(F.count("*").alias("m"))
            .groupBy("term", "entity", "df").agg(F.sum("m").alias("both"), F.sum(F.col("m") * F.col("m")).alias("squares"))
            .withColumn("kinds", F.col("both") * F.col("both") / F.col("squares")).where(telling(lower_limit(F.lit(1.0), F.col("kinds")))))
    # the texts of other entities, already at hand, rule out most words: more texts only tell less
    maybe = settled(judged(both, pairs.groupBy("term").agg(F.count("*").alias("texts"))), "privacy-maybe")
    table = bit_table(maybe)
    copied = bit_table(known.where("copies > 1").select(F.col("text_key").alias("term")))
    return judged(maybe, text_counts(docs, table, copied)).select("term").distinct()


def bit_table(terms: DataFrame) -> np.ndarray:
    """2 ** TABLE_BITS bits, one set per term by the low bits of its hash."""
    low = F.col("term").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    rows = (terms.select(F.shiftright(low, 6).alias("at"), F.col("term").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
            .groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect())
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for row in rows:
        table[row["at"]] = row["bits"]
    return table.view(np.uint64)


def _maybe(f: _Free, table: np.ndarray) -> np.ndarray:
    """Indexes of the free words that may be in the table."""
    return np.flatnonzero(f.free & _in(table, f.words.hash))


_SEEN = 1_000_000


def added_spans(docs: DataFrame, terms: DataFrame, table: np.ndarray) -> DataFrame:
    """(text_key, added): all places of disclosing terms in every text that has one."""
    B.prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()              # copies of a text give the same places
        for batch in it:
            for part in B.slices(batch):
                f = _Free(part)
                w = _maybe(f, table)
                keys = {k: text_key(f.texts[k]) for k in np.unique(f.doc[w]).tolist()}
                new = {}
                for k, key in keys.items():
                    if key not in seen:
                        seen.add(key)
                        new[k] = key
                w = w[np.isin(f.doc[w], list(new))]
                start, end = f.places(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new[k] for k in f.doc[w].tolist()], pa.int64()), pa.array(B.signed(f.words.hash[w])),
                     pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["text_key", "term", "start", "end"])
                if len(seen) > _SEEN:
                    seen.clear()

    places = (docs.select("text").mapInArrow(B.released(run), "text_key long, term long, start int, end int")
              .withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int")))
    spread = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (places.join(spread, ["term", "salt"]).groupBy("text_key")
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("added")))


def _with_added(rows: DataFrame, key: str, added: DataFrame, name: str) -> DataFrame:
    """``rows`` with the added spans of their text; the rows of one text are salted."""
    salt, other = free_name(rows, "_salt"), free_name(rows, "_text_key")
    spread = (added.withColumnsRenamed({"text_key": other, "added": name})
              .withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1)))))
    salted = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(COPY_SALTS)).cast("int"))
    return salted.join(spread, (salted[key] == spread[other]) & (salted[salt] == spread[salt]), "left").select(
        *[salted[c] for c in rows.columns], spread[name])


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> DataFrame:
    """Per document: counts, base spans and the spans that the method adds; no text."""
    found = settled(found_data(docs), "privacy-found")
    terms = settled(disclosing(found, docs, disclosure, residual), "privacy-terms")
    added = added_spans(docs, terms, bit_table(terms))
    return _with_added(found.drop("entities", "prints"), "text_key", added, "added").select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def privacy_report(docs: DataFrame) -> DataFrame:
    """The digest columns of ``personal_data``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    added = F.transform("added", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    return personal_data(docs).select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> DataFrame:
    """The documents with base spans and disclosing terms generalised to their kind.

    Texts without a word that may be a disclosing term are done in place; only
    the others meet their added spans by the key of the text. They are written
    before that: no task holds two Python workers, which would live on.
    """
    B.prepare(docs.sparkSession)
    found = settled(found_data(docs), "privacy-found")
    terms = settled(disclosing(found, docs, disclosure, residual), "privacy-terms")
    table = bit_table(terms)
    added = settled(added_spans(docs, terms, table), "privacy-added")
    columns, key_name = docs.columns, free_name(docs, "_key")
    more_name = free_name(docs.withColumn(key_name, F.lit(0)), "_added")

    def masked(part: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        new = [None if t is None else redacted(t, [(KINDS[k], a, b) for k, a, b in base_spans(t)]
                                               + [("term", x["start"], x["end"]) for x in more or []])
               for t, more in zip(part.column("text").to_pylist(), spans)]
        i = part.schema.get_field_index("text")
        return part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))

    def touched(part: pa.RecordBatch) -> tuple[_Free, np.ndarray]:
        f, hit = _Free(part), np.zeros(part.num_rows, bool)
        hit[f.doc[_maybe(f, table)]] = True
        return f, hit

    def quiet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                rest = part.filter(pa.array(~touched(part)[1]))
                yield masked(rest, [None] * rest.num_rows)

    def telling(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                f, hit = touched(part)
                keys = pa.array([text_key(t) for t, h in zip(f.texts, hit) if h], pa.int64())
                yield part.filter(pa.array(hit)).append_column(key_name, keys)

    def cover(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in B.slices(batch):
                yield masked(part.select(columns), part.column(more_name).to_pylist())

    keyed = settled(docs.mapInArrow(B.released(telling), StructType([*docs.schema.fields, StructField(key_name, LongType())])),
                    "privacy-telling")
    joined = _with_added(keyed, key_name, added, more_name).drop(key_name)
    return docs.mapInArrow(B.released(quiet), docs.schema).unionByName(joined.mapInArrow(B.released(cover), docs.schema))
