"""Secret scans: known shapes, and strings that a tokenizer's vocabulary does not compress."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common, tokens

#: Kinds in the order in which spans of one start stand.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs of 32 or more
LEAST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Digests (by their lengths in hex) and identifiers that look random but are public.
_DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+").fullmatch
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}").fullmatch
_NUMBER = re.compile(r"[0-9+/_=-]+").fullmatch
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_/-][A-Za-z]+)*[_/-]?[0-9]{0,4}").fullmatch
#: Words of an identifier in camel or snake case.
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Letters a token, over the lower-case words of an identifier, above which it is one; random letters stay below.
WORD_RATIO = 2.3

_ENCODINGS: dict[str, object] = tokens.held({})


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODINGS[path] = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three known shapes; leftmost matches that do not overlap, short ones dropped."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def public_string(s: str, encoding) -> bool:
    """A digest, a number or an identifier whose words the vocabulary compresses: excluded from the token-efficiency test."""
    if _NUMBER(s) or _UUID(s) or (_HEX_ONLY(s) and len(s) in _DIGEST_LENGTHS):
        return True
    if not _IDENTIFIER(s):
        return False
    words = _WORD.findall(s)
    return sum(map(len, words)) > WORD_RATIO * sum(len(encoding.encode_ordinary(" " + w.lower())) for w in words)


def random_spans(text: str, encoding, *, ratio: float, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidate strings, or what the known spans leave of them, with at most `ratio` characters for each token.

    What is left of a candidate beside known spans takes the test by itself. A part of fewer than LEAST characters does
    so beside a key or hex run only (a value runs to its own end, so before an assignment stands a name), and not if
    it ends in '=', as a name does.
    """
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(known) and known[k][2] <= a:
            k += 1
        at, rest = a, []
        j = k
        while j < len(known) and known[j][0] < b:
            start, kind, end = known[j]
            j += 1
            if start > at and (start - at >= LEAST or (kind > 0 and text[start - 1] != "=")):
                rest.append((at, start))
            at = max(at, end)
        if at < b:
            rest.append((at, b))
        for x, y in rest:
            s = text[x:y]
            # the ratio first: few strings pass it
            if len(s) <= ratio * len(encoding.encode_ordinary(s)) and not public_string(s, encoding):
                out.append((x, 3, y))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", ratio: float = 2.0, mask: str | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans and, with `mask`, the text with spans masked.

    Offsets are code points, ends exclusive. The known shapes always stay; strings of 16 or more characters with at
    most `ratio` characters per token of the vocabulary are added as kind `random` unless they are digests, numbers or
    identifiers of words; of a string that a known shape covers in part, the parts beside it are tested. A null or
    empty text has no spans (and stays as it is under `mask`); long texts are read whole, in time linear in their
    spans; spans of one start stand in the order of KINDS; repeated rows and null ids stay; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """

    def run(batches):
        tokens.release(_ENCODINGS)
        encoding = _encoding(vocabulary)
        for batch in batches:
            keys = batch.column(0)
            for a, b, texts in tokens.slices(batch.column(1), 2_000_000, nulls=True):
                n, digests, spans, masked = ([], [], []), [], [], []
                for text in texts:
                    known = base_spans(text or "")
                    every = sorted(known + random_spans(text or "", encoding, ratio=ratio, known=known))
                    for kind in range(3):
                        n[kind].append(sum(x[1] == kind for x in known))
                    digests.append(hashlib.sha256(joined(known).encode()).hexdigest())
                    spans.append(joined(every))
                    if mask is not None:
                        masked.append(text if not every else mask_spans(text, every, mask))
                arrays = [keys[a:b], *(pa.array(x, pa.int64()) for x in n), pa.array(digests), pa.array(spans)]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                if mask is not None:
                    arrays.append(pa.array(masked, pa.string()))
                    names.append("masked")
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema + ", masked string" * (mask is not None))


def mask_spans(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """Overlapping spans become one mask."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, vocabulary: str, *, text_col: str = "text", length_col: str | None = None, ratio: float = 2.0, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs with every span of the texts masked; length_col, if named, follows the new text.

    Null texts stay null (and so does their length), empty ones empty; overlapping spans become one mask; repeated
    rows stay; other columns, whatever their names, are passed on; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        tokens.release(_ENCODINGS)
        encoding = _encoding(vocabulary)
        for batch in batches:
            for a, b, texts in tokens.slices(batch.column(at), 2_000_000, nulls=True):
                out = []
                for text in texts:
                    known = base_spans(text or "")
                    every = sorted(known + random_spans(text or "", encoding, ratio=ratio, known=known))
                    out.append(mask_spans(text, every, mask) if every else text)
                yield batch.slice(a, b - a).set_column(at, text_col, pa.array(out, pa.string()))

    out = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, docs.schema)
    return out if length_col is None else out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col]))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents; see scan() for hostile rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    return scan(docs, common.tokenizer_path("byte_bpe_50k.tiktoken"))
