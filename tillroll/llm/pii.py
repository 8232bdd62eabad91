"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
plus signs, digits, scheme marks and the words that announce an identifier. At
each anchor a local parser expands to both sides, decides where the entry ends
and checks it. Nothing else of the text is looked at, and what an entry covers
is not looked at again for its kind.

Kinds, in the order of the result:

* ``email``  local part, at-sign, dotted domain; also an at-sign or dot written
  out in brackets, as in ``name [at] host [dot] org``
* ``ip``     four numbers of at most 255
* ``card``   16 to 19 digits that pass the Luhn check
* ``phone``  ``+`` and 8 to 15 digits
* ``url``    a web address that names a person: one with user information, a
  ``mailto:`` or ``tel:`` address without a written-out mark above, or a path
  of a user's own
* ``account`` the value that follows a cue (IBAN, account, passport, password,
  token, key ...) and a mark such as ``:`` or ``=``; it holds a digit, and that
  of an IBAN passes its check digits

The first four are fixed in their base form; the others and the written-out
forms are added and never change a base entry.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

#: Words that announce an identifier, in any of three spellings
#: (small, Capital, CAPITALS).
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "reisepass", "pasaporte", "passeport",
        "ssn", "social security number", "tax id", "driver license", "password", "passwd", "passwort",
        "mot de passe", "contraseña", "secret", "token", "api_key", "api key", "apikey", "access key",
        "access_key", "user id", "user_id", "login")
#: Written-out at-signs, and paths that belong to a person.
WRITTEN_AT = ("[at]", "(at)", "{at}")
OWN_PATH = ("/~", "/@", "/u/", "/user/", "/users/", "/profile/", "/in/")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
WRITTEN_HOST = re.compile(r" ?([A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]+)+)", re.I)
ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^\[\]]*")
VALUE = re.compile(r"(?: (?:number|no|nr|id|key)\.?| is| ist| es| est)?[\"']? ?(?:[:=#]|=>) ?[\"']?([A-Za-z0-9][A-Za-z0-9_+/.-]{3,})"
                   r"((?: [A-Z0-9]{2,4}){0,8})", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Whether the check digits of an IBAN fit."""
    return bool(IBAN.fullmatch(text)) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _left(text: str, at: int, floor: int) -> int:
    """Start of the run of local-part characters before ``at``, from ``floor``."""
    while at > floor and text[at - 1] in LOCAL:
        at -= 1
    return at


class Finder:
    """Finds the entries of one text after the other."""

    def __init__(self):
        words = ahocorasick.Automaton()
        marks = {"@": "at", "+": "plus", "://": "scheme", "mailto:": "address", "tel:": "address"}
        marks |= dict.fromkeys("0123456789", "digit") | dict.fromkeys(WRITTEN_AT, "written")
        for cue in CUES:
            marks |= dict.fromkeys((cue, cue.capitalize(), cue.upper()), "cue")
        for mark, what in marks.items():
            words.add_word(mark, (what, len(mark)))
        words.make_automaton()
        self.words = words

    def __call__(self, text: str) -> dict[str, list[tuple[int, int, bool]]]:
        """By kind: (start, end, base), in order of their starts. Positions count
        code points, ends are exclusive."""
        found = {k: [] for k in KINDS}
        # how far the base entries, dropped ones too, have used the text
        used = {"email": 0, "ip": 0, "card": 0, "phone": 0, "url": 0}
        for last, (what, size) in self.words.iter(text):
            at = last - size + 1
            if what == "digit":
                self.number(text, at, used, found)
            elif what == "at":
                self.email(text, at, used, found)
            elif what == "plus":
                self.phone(text, at, used, found)
            elif what == "written":
                self.written(text, at, size, found)
            elif what == "cue":
                self.account(text, at, size, found)
            else:
                self.url(text, at, size, what, used, found)
        return {k: _without_overlaps(v) for k, v in found.items()}

    def email(self, text, at, used, found):
        start = _left(text, at, used["email"])
        host = DOMAIN.match(text, at + 1)
        if start < at and host:
            used["email"] = host.end()
            found["email"].append((start, host.end(), True))

    def number(self, text, at, used, found):
        """A digit: the first of a dotted chain, of a card number, of both or none."""
        if at >= used["ip"]:
            # the whole chain of numbers and dots is used up, four numbers at a time
            end = CHAIN.match(text, at).end()
            pos = at
            while (m := IP.match(text, pos, end)):
                if all(len(n := x.lstrip("0")) <= 3 and int(n or 0) <= 255 for x in m.groups()):
                    found["ip"].append((m.start(), m.end(), True))
                pos = m.end() + 1
            used["ip"] = end
        if at >= used["card"]:
            m = DIGITS.match(text, at)
            used["card"] = m.end() if m else at + 1
            if m and m.end() - at >= 16:
                digits = NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((at, m.end(), True))

    def phone(self, text, at, used, found):
        m = PHONE.match(text, at) if at >= used["phone"] else None
        if not m:
            return
        end = m.end()
        while text[end - 1] not in "0123456789":
            end -= 1
        if end - at < 4:  # plus sign, digit, one character more, digit
            return
        used["phone"] = end
        if 8 <= len(NOT_DIGIT.sub("", text[at:end])) <= 15:
            found["phone"].append((at, end, True))

    def written(self, text, at, size, found):
        before = at - (at > 0 and text[at - 1] == " ")
        start = _left(text, before, 0)
        host = WRITTEN_HOST.match(text, at + size)
        if start < before and host:
            found["email"].append((start, host.end(), False))

    def url(self, text, at, size, what, used, found):
        if at < used["url"]:
            return
        start = at
        if what == "scheme":
            while start > 0 and (text[start - 1] in LOCAL and text[start - 1] not in "_%"):
                start -= 1
            if start == at:
                return
        end = used["url"] = ADDRESS.match(text, at + size).end()
        while end > at + size and text[end - 1] in ".,;:!?)*&%$#":
            end -= 1
        rest = text[at + size:end]
        host, slash, path = rest.partition("/")
        named = ("@" in host or any(p in slash + path for p in OWN_PATH)) if what == "scheme" else \
            any(c in "@0123456789" for c in rest)
        if named and rest:
            found["url"].append((start, end, False))

    def account(self, text, at, size, found):
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            return
        m = VALUE.match(text, at + size)
        if not m:
            return
        groups = m.group(1) + m.group(2).replace(" ", "")
        if text[at:at + size].lower() == "iban" or iban_valid(groups):
            # as many groups as the check digits ask for
            ends = [m.end(1)] + [m.start(2) + g.end() for g in re.finditer(r" [A-Za-z0-9]+", m.group(2))]
            for end in reversed(ends):
                if iban_valid(text[m.start(1):end].replace(" ", "").upper()):
                    found["account"].append((m.start(1), end, False))
                    return
            if text[at:at + size].lower() == "iban":
                return
        value = m.group(1).rstrip(".-/+")
        if len(value) >= 6 and any(c in "0123456789" for c in value):
            found["account"].append((m.start(1), m.start(1) + len(value), False))


def _without_overlaps(entries):
    """Base entries, and the added ones that touch none and no added one before."""
    base = [e for e in entries if e[2]]
    if len(base) == len(entries):
        return sorted(base)
    out, at, end = [], 0, 0
    base.sort()
    for e in sorted(e for e in entries if not e[2]):
        while at < len(base) and base[at][1] <= e[0]:
            at += 1
        if e[0] >= end and not (at < len(base) and base[at][0] < e[1]):
            out.append(e)
            end = e[1]
    return sorted(base + out)


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col long, text, spans), a row a row of ``docs``: the entries of its
    text as structs (kind, start, end, base), by kind and start; positions
    count code points.

    Null and empty texts have none and stay as they are. Null ids, repeated ids
    and repeated rows are rows like others; an empty table gives an empty
    result; other columns are ignored. A text is held once by its task."""
    def scan(batches):
        finder = Finder()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = finder(text or "")
                rows.append([{"kind": k, "start": s, "end": e, "base": b} for k in KINDS for s, e, b in found[k]])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)],
                                             ["id", "text", "spans"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(scan, f"id long, text string, spans {SPAN}")
            .withColumnsRenamed({"id": id_col, "text": text_col}))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone long: base entries; base_sha256
    of their list, spans: the list of all entries), a row a row of ``docs``. A
    list has kind:start:end of each entry, joined by commas. Nulls as in
    :func:`find`; the texts stay in the tasks."""
    def scan(batches):
        finder = Finder()
        for batch in batches:
            counts, sums, lists = [[] for _ in BASE], [], []
            for text in batch.column(1).to_pylist():
                found = finder(text or "")
                for out, k in zip(counts, BASE):
                    out.append(sum(b for _, _, b in found[k]))
                base = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e, b in found[k] if b)
                sums.append(hashlib.sha256(base.encode()).hexdigest())
                lists.append(",".join(f"{k}:{s}:{e}" for k in KINDS for s, e, _ in found[k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()),
                 pa.array(lists, pa.string())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string"))
            .mapInArrow(scan, "id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")
            .withColumnRenamed("id", id_col))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col), a row a row of ``docs``: each entry replaced by its
    kind in angle brackets. Of entries of different kinds that overlap, the one
    that starts first (then the longer) is replaced. Null texts stay null."""
    def scan(batches):
        finder = Finder()
        for batch in batches:
            texts = []
            for text in batch.column(1).to_pylist():
                out, end = [], 0
                found = finder(text or "")
                for s, e, k in sorted(((s, e, k) for k in KINDS for s, e, _ in found[k]),
                                      key=lambda x: (x[0], -x[1], x[2])):
                    if s >= end:
                        out += [text[end:s], f"<{k}>"]
                        end = e
                texts.append(text if text is None else "".join(out) + text[end:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(scan, "id long, text string").withColumnsRenamed({"id": id_col, "text": text_col}))
