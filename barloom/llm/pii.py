"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand and check them."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks

BASE_KINDS = ("email", "ip", "card", "phone")
#: In the order that breaks ties of starts: base kinds first, then those the anchors add.
KINDS = (*BASE_KINDS, "url", "account")
_RANK = {k: i for i, k in enumerate(KINDS)}

# Local parsers: each is tried at one place that an anchor names.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_ACCOUNT = re.compile(r"[\x20:=#.\"']{0,4}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{4}){2,7}(?:\x20?[A-Za-z0-9]{1,4})?|[0-9](?:[\x20-]?[0-9]){5,33})(?![A-Za-z0-9])")

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for c in "0123456789":
        automaton.add_word(c, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for s in SCHEMES:
        automaton.add_word(s, ("scheme", len(s)))
    for s in CUES:
        automaton.add_word(s, ("cue", len(s)))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    """The text with ASCII letters lowered and no others, so that places in it are places in the text."""
    return text.encode().lower().decode()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved.upper())) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, in order of start and kind. Base kinds are leftmost and do not overlap within a kind."""
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended; nothing of that kind starts before
    last_digit = -2
    for end, (anchor, length) in _automaton().iter(_lower(text)):
        at = end - length + 1
        if anchor == "digit":
            run_starts = at != last_digit + 1
            last_digit = at
            # a match begins at the first digit of a run; later digits of it lead to the same end
            if (run_starts or at == done["ip"]) and at >= done["ip"] and (m := _IP.match(text, at)):
                done["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    found.append(("ip", at, m.end()))
            if (run_starts or at == done["card"]) and at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = _digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, m.end()))
        elif anchor == "at":
            # the whole run of local characters left of the sign, as far as the last address allows
            start = at
            while start > done["email"] and _is_local(text[start - 1]):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                done["email"] = m.end()
                found.append(("email", start, m.end()))
        elif anchor == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", at, m.end()))
        elif anchor == "scheme":
            # the character before comes first: reading on to the next blank for every scheme would be quadratic
            if at >= done["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := _URL.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)]"))
                if stop > end + 1:
                    done["url"] = stop
                    found.append(("url", at, stop))
        elif at == 0 or not text[at - 1].isalnum():  # a cue, as a word of its own
            if (m := _ACCOUNT.match(text, end + 1)) and m.start(1) >= done["account"] and m.start(1) > end + 1:
                code = m[1].replace(" ", "").replace("-", "")
                if code[0] in "0123456789" or _iban(code):
                    done["account"] = m.end(1)
                    found.append(("account", m.start(1), m.end(1)))
    found.sort(key=lambda s: (s[1], _RANK[s[0]]))
    return found


def _is_local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        counts, hashes, spans = [], [], []
        for text in batch["text"].to_pylist():
            found = find_spans(text)
            base = [s for s in found if s[0] in BASE_KINDS]
            counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
            hashes.append(hashlib.sha256(digest(base).encode()).hexdigest())
            spans.append(digest(found))
        by_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE_KINDS))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *by_kind, pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                                         ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts and spans of every text, one pass without a shuffle. A null text counts as empty; ids may be null or repeat."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scan, SPANS)


def masked(text: str) -> str:
    """The text with each span replaced by <kind>; of overlapping spans the first stays, of those with one start the longest."""
    spans = sorted(find_spans(text), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        else:
            if end <= at:
                continue
            # the rest of an overlapping span goes with the one before it
        at = end
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = [None if t is None else masked(t) for t in batch["text"].to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), pa.field("text", pa.string()), pa.array(texts, pa.string()))


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in `text`; n_chars, where there is one, counts the new text. Null texts stay null."""
    out = docs.mapInArrow(_mask, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
