"""Secret scan: three fixed patterns, and strings near sensitive words whose bytes zstandard cannot foresee.

The novelty of a candidate is its marginal compressed size: bytes of (text around + candidate) less bytes of the text
around, under a dictionary.  A candidate is a run of 16 or more letters, digits and marks with a sensitive word at most
NEAR characters before or behind it; one whose marginal bytes are at least NOVEL of its length is reported as kind
``novel``, unless a pattern's span touches it.  Nothing else decides: no count of digits, marks or letters.  In
``name=value`` with the sensitive word in the name the value alone is the candidate.

The dictionary is trained (``train_primer``) on identifiers of programs and on the words of all documents, counted whole:
their language, names and code are what the compressor foresees.  Runs of 16 and more with a digit are left out of it, so a
secret that many documents repeat does not become foreseen.  Its bound is its own size.

Rows: null and empty texts have no span; repeated rows and null ids are scanned row by row; an empty table gives no
row; ``find_secrets`` ignores other columns and ``redact`` keeps them.  Positions are in code points, end exclusive.
Spans are ordered by start, then by kind as listed in KINDS, then by end.
"""

from __future__ import annotations

import builtins
import itertools
import keyword
import re
import sys
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import textbuf

KINDS = ("assign", "access", "hex", "novel")
SPAN_SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Words that make the text around them sensitive (fixed values).
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "api key", "credential", "bearer", "authorization", "private key", "private_key", "access key", "access_key", "client_key", "auth_key", "signing key", "signing_key", "encryption key", "aws_", "ssh-rsa")
_CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
_ASSIGNED = re.compile(r"=+(?=[^=])")
#: Rows that hold nothing of this, in any case, have no span.
_MAY_HOLD = "|".join(["passw", "api_?key", "AKIA", "[0-9a-f]{24}", *map(re.escape, SENSITIVE)])
#: Identifiers and phrases that are no secret (fixed values), for the dictionary.
IDENTIFIERS = (
    "import from return self class function const static public private void string integer boolean float double "
    "getElementById document.createElement application/json text/html charset=utf-8 Content-Type Content-Length "
    "Authorization Bearer Basic access_token refresh_token client_id client_secret api_key password username "
    "localhost 127.0.0.1 example.com http:// https:// www. .com .org .net .html index.php config.yaml settings.json "
    "environment variable os.environ process.env placeholder changeme your_api_key_here your-token-here xxxxxxxxxxxx "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 ffffffffffffffff "
    "sha256 sha1 md5 base64 encode decode encrypt decrypt signature certificate BEGIN END PRIVATE PUBLIC KEY"
)
NEAR = 48  # characters between a sensitive word and a candidate
AROUND = 400  # characters of text on either side that prime the compressor
#: Marginal bytes by byte of the candidate.  On held-out code a share of 1 or 2 in 100 of all identifiers of 16 and more
#: characters reaches it, of random strings 95 in 100 and more (README).
NOVEL = 0.75
DICTIONARY_BYTES = 112_640
LEAST = 4  # characters of a word: no shorter one can be met by zstandard
WORD_BYTES = 81_920  # of the dictionary, for words of the documents
WORDS = WORD_BYTES // LEAST  # words fetched at once


def _names() -> list[bytes]:
    """Identifiers by rule: words, built-in names and module names of the running language, in three spellings."""
    found = {*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *IDENTIFIERS.split()}
    for kind in (str, bytes, list, dict, set, int, float, object):
        found.update(dir(kind))
    spelled = [" ".join((x, x.title(), x.upper())) for x in sorted(found)]
    return [IDENTIFIERS.encode(), *(" ".join(spelled[k : k + 20]).encode() for k in range(0, len(spelled), 20))]


def primer(pieces: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of identifiers and of ``pieces`` of text, without their runs that hold a digit."""
    clean = [_CANDIDATE.sub(lambda m: " " if any(map(str.isdigit, m[0])) else m[0], x).encode("utf-8", "replace") for x in pieces]
    return zstandard.train_dictionary(size, _names() * 4 + clean).as_bytes()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of a candidate's characters, LEAST and more long, over all whole texts: n is the rows
    that hold it.  A run as long as a candidate counts once for equal texts (told by a 64-bit hash), and one of them
    with a digit does not count, so no secret becomes foreseen by repeating it."""
    text = F.col("text").cast("string")
    long = F.length("word") >= 16
    each = docs.select(F.xxhash64(text).alias("k"), F.explode(F.array_distinct(F.split(text, "[^A-Za-z0-9+/_=.-]+"))).alias("word"))
    each = each.filter((F.length("word") >= LEAST) & ~(long & F.col("word").rlike("[0-9]")))
    rows = each.groupBy("word", F.when(long, F.col("k")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("word").agg(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(1)).alias("n"))


def _held_words(counts: DataFrame) -> list[str]:
    """The words of ``counts`` by the bytes that they take, each that the room left in WORD_BYTES holds.  All are gone
    through: behind the first WORDS come, only if there is room still, those that fit it; no longer one is fetched."""
    rows = counts.select("word", (F.col("n") * F.length("word")).alias("taken"))
    kept, room, after = [], WORD_BYTES, F.lit(True)
    while room > LEAST:
        found = rows.filter(after & (F.length("word") < room)).coalesce(32).orderBy(F.desc("taken"), "word").limit(WORDS).collect()
        for word in (r["word"] for r in found):
            if len(word) < room:
                kept.append(word)
                room -= len(word) + 1
        if len(found) < WORDS:
            break
        last = found[-1]
        after = (F.col("taken") < last["taken"]) | ((F.col("taken") == last["taken"]) & (F.col("word") > last["word"]))
    return kept


def train_primer(docs: DataFrame) -> bytes:
    """The dictionary for ``docs``: a trained one, whose tables of byte frequencies know the words, with those words of
    ``word_counts`` behind it that are in two rows and more, by the bytes that they take, as many as WORD_BYTES hold."""
    kept = _held_words(word_counts(docs).filter("n > 1"))
    head = primer([" ".join(kept[k : k + 100]) for k in range(0, len(kept), 100)], DICTIONARY_BYTES - WORD_BYTES)
    return head + "".join(f" {word}" for word in reversed(kept)).encode()


@lru_cache(1)
def _plain_primer() -> bytes:
    return primer([])


@lru_cache(2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def marginal_bytes(candidate: str, around: str, dictionary: bytes | None = None) -> int:
    """Compressed bytes that ``candidate`` adds to the text around it."""
    z = _compressor(dictionary or _plain_primer())
    return len(z.compress((around + candidate).encode("utf-8", "replace"))) - len(z.compress(around.encode("utf-8", "replace")))


def base_spans(text: str, low: str | None = None) -> list[tuple[str, int, int]]:
    low = text.lower() if low is None else low
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def novel_spans(text: str, taken: list[tuple[str, int, int]], dictionary: bytes | None = None) -> list[tuple[str, int, int]]:
    """Candidates in sensitive context that are incompressible there."""
    marks = [(m.start(), m.end()) for m in _CONTEXT.finditer(text)]
    out, k = [], 0
    taken = sorted((s, e) for _, s, e in taken)
    t = 0
    for m in _CANDIDATE.finditer(text) if marks else ():
        s, e = m.start(), m.start() + len(m[0].rstrip(".-"))
        while k + 1 < len(marks) and marks[k + 1][1] <= s:
            k += 1
        while t < len(taken) and taken[t][1] <= s:
            t += 1
        behind = next((x for x in itertools.islice(marks, k, None) if x[0] >= e), None)
        near = (marks[k][1] <= s and s - marks[k][1] <= NEAR) or (behind is not None and behind[0] - e <= NEAR)
        for at in [*_values(text, s, e, marks, k), *([s] if near else [])]:
            touched = any(b > at for _, b in itertools.takewhile(lambda x: x[0] < e, itertools.islice(taken, t, None)))
            if touched or e - at < 16:
                continue
            around = text[max(0, at - AROUND) : at] + text[e : e + AROUND]
            if marginal_bytes(text[at:e], around, dictionary) >= NOVEL * (e - at):
                out.append(("novel", at, e))
                break
    return out


def _values(text: str, s: int, e: int, marks: list[tuple[int, int]], k: int) -> list[int]:
    """Where values begin in the candidate (s, e): after each ``=`` that a sensitive word ending in the candidate is near."""
    found = []
    for m in _ASSIGNED.finditer(text, s, e):
        while k + 1 < len(marks) and marks[k + 1][1] <= m.start():
            k += 1
        if s < marks[k][1] <= m.start() and m.end() - marks[k][1] <= NEAR:
            found.append(m.end())
    return found


def spans(text: str | None, dictionary: bytes | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text; without a dictionary, under that of identifiers alone."""
    if not text:
        return []
    low = text.lower()
    found = base_spans(text, low)
    if any(w in low for w in SENSITIVE):
        found += novel_spans(text, found, dictionary)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _each(column: pa.Array, work, otherwise) -> list:
    """``work(text)`` of the texts that may hold a span, ``otherwise`` of the rest, told by one vectorised search."""
    may = pc.fill_null(pc.match_substring_regex(column, _MAY_HOLD, ignore_case=True), False).to_pylist()
    return [work(x.as_py()) if m else otherwise(x) for m, x in zip(may, column, strict=True)]


def find_secrets(docs: DataFrame, dictionary: bytes | None = None) -> DataFrame:
    """(doc_id, spans) of every row, under ``dictionary`` or that of ``train_primer``."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary or train_primer(docs))

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = _each(part.column(1), lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in spans(t, sent.value)], lambda _: [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textbuf.frugal(run), SPAN_SCHEMA)


def redacted(text: str | None, mark: str = "[SECRET]", dictionary: bytes | None = None) -> str | None:
    """The text with every span, touching spans as one, replaced by ``mark``."""
    found = spans(text, dictionary)
    if not found:
        return text
    out, at, end = [], 0, -1
    for _, s, e in found:
        if s >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:s])
        end = max(end, e)
    return "".join([*out, mark, text[end:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", dictionary: bytes | None = None) -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced; all columns and rows stay."""
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(dictionary or train_primer(docs))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                kind = part.schema.field(at)
                found = _each(part.column(at), lambda t: redacted(t, mark, sent.value), lambda x: x.as_py())
                yield part.set_column(at, kind, pa.array(found, kind.type))

    return docs.mapInArrow(textbuf.frugal(run), docs.schema)
