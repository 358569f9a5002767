"""Surrogates for personal data and secrets.

Entities are found by fixed patterns and written in a normal form (digits only, lower case), so
each way of writing one shares its surrogate, in every document. A surrogate comes from a
keyed hash of kind, normal form and attempt, and has the form of what it replaces: lengths,
classes of characters, separators, letter case, country code, private network, card checksum,
script, and for names the gender that the title or the name tells.

Attempt 0 is taken unless it collides: all distinct entities are checked together, and one whose
surrogate is also an entity of the corpus, or taken by another, goes on to its next attempt, inside the same format. Before that
the entities of each fixed format (digits of a phone, card or security number, addresses, secrets of one shape) are counted: where more than
half of all its values are taken, an error says so, as no distinct ones could be found; only secrets of such a shape grow by letters. Names have as many syllables as attempts ask for, and
mail names may grow. A secret has a letter or digit; signs alone are none. After attempt WIDER addresses of small private networks go to the largest one. Almost all
entities keep attempt 0, which needs no table; the others' attempts are broadcast while
their checked number is small, and else joined to their documents.

Names are up to three capitalised words after a title, which end before the next title, or a common given name and the capitalised word after it.
The words of a name found so are replaced wherever else they stand in the document, capitalised and without a title.
A given name has the gender that any of its mentions in the document tells, so "Dr. Kim Lee" and "Mrs. Kim Lee" stay one person; the
stem of its surrogate doesn't depend on the gender, only its ending does.

Null texts stay null, empty and very long ones are handled like all others. Texts without entities stay as they are. Repeated rows and null doc_ids stay;
other columns stay under their own names, and the new column gets a name that none of them has. No rows: no result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, fresh

WIDER = 12
#: Secrets of a shape with too few values start at this attempt, from which on they grow.
GROW = 1_000
#: More exceptions than this are joined instead of broadcast.
BROADCAST_EXCEPTIONS = 20_000

# Titles with the gender they tell, and common given names.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "госпожа", "κυρία"]
OTHER_TITLES = ["Dr", "Prof", "Professor"]
GIVEN = {
    ("latin", "m"): ["James", "Peter", "Thomas", "Daniel", "Martin", "Paul", "Victor", "Simon", "Hugo", "Felix", "Oscar", "Bruno", "Louis", "Carlos", "Andrew", "Stefan"],
    ("latin", "f"): ["Mary", "Anna", "Laura", "Sarah", "Julia", "Clara", "Helena", "Sofia", "Emma", "Lucia", "Marta", "Irene", "Alice", "Diana", "Nora", "Elisa"],
    ("latin", "u"): ["Alex", "Robin", "Kim", "Sam", "Charlie", "Jamie", "Taylor", "Morgan", "Casey", "Jordan", "Sasha", "Noel", "Rowan", "Quinn", "Avery", "Dana"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Николай", "Павел", "Олег", "Виктор"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Вера"],
    ("cyrillic", "u"): ["Саша", "Женя", "Валя", "Слава"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Κώστας", "Πέτρος", "Παύλος", "Ανδρέας"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Δήμητρα"],
    ("greek", "u"): ["Άγγελος", "Φώτης"],
}
SYLLABLES = {
    "latin": ["ba", "ber", "cor", "da", "del", "fen", "gar", "hal", "kel", "lan", "mar", "mer", "nor", "par", "rin", "sen", "tal", "ton", "ver", "wil"],
    "cyrillic": ["ба", "бор", "вел", "гор", "дан", "зор", "кал", "лев", "мир", "нов", "пол", "рад", "сев", "тер", "хар", "чер"],
    "greek": ["βα", "γαλ", "δημ", "ζαν", "καρ", "λου", "μαν", "νικ", "παν", "ρου", "σαν", "τσα", "φιλ", "χρι"],
}
ENDINGS = {"latin": {"m": "o", "f": "a", "u": "y"}, "cyrillic": {"m": "", "f": "а", "u": "я"}, "greek": {"m": "ος", "f": "α", "u": "ι"}}
EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
SECRET = re.compile(r"(?i)(?:password|passwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key)[^\w\"'\n]{0,10}[=:][^\w\"'\n]{0,6}[\"']?([A-Za-z0-9_\-./+=]{6,})")
IP = re.compile(r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\.?\d)")
CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7})(?!\d)")
PHONE = re.compile(r"(?<![\d+])(?:\+(\d{1,3})[^\w+]{1,8}\d{2,4}[^\w+]{1,8}\d{3,4}[^\w+]{1,6}\d{3,4}|\(\d{3}\)[^\w+]{1,6}\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)")
#: A country code and the groups after it, or both in one; a US number by a bracketed area, or by groups of 3, 3 and 4.
INTERNATIONAL = re.compile(r"\+(\d{1,15}(?:[ .\-/\u00a0()]{1,3}\d{1,8}){0,6})(?!\d)")
BRACKETED = re.compile(r"\(\d{3}\)[^\w+]{0,6}\d{3}[ .\-\u00a0]\d{4}(?!\d)")
GROUPED = re.compile(r"[2-9]\d{2}[ .\-\u00a0][2-9]\d{2}[ .\-\u00a0]\d{4}(?!\d)")
COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69]\d|3[578]\d|42\d|5[09]\d|6[7-9]\d|8[05-8]\d|9[679]\d")
SPLIT_CARD = re.compile(r"\d{4}([ \-])\d{6}\1\d{4,5}(?!\d)")
SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_TITLES = [*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES]
TITLE = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True)) + r")\b\.?(?=[ \u00a0])")
WORD = re.compile(r"[^\W\d_][\w'’\-]*")
NEXT_WORD = re.compile(r"[ \u00a0]{1,2}([^\W\d_][\w'’\-]*)")
_KNOWN = {n.casefold(): g for (_, g), names in GIVEN.items() for n in names}
_GIVEN = [n for names in GIVEN.values() for n in names]


def session_key(spark: SparkSession, default: str | None = None) -> bytes:
    """The secret key of the session's setting spark.pathledger.surrogateKey; an error if there is none and no default."""
    found = spark.conf.get("spark.pathledger.surrogateKey", default)
    if not found:
        raise ValueError("set spark.pathledger.surrogateKey: surrogates need a secret key")
    return found.encode()


def _stream(kind: str, canon: str, attempt: int, key: bytes) -> Callable[[int], int]:
    """Numbers below a given one, as many as are asked for."""
    seed, state = f"{kind}\0{canon}\0{attempt}".encode("utf-8", "surrogatepass"), {"n": 0, "x": 0, "left": 0}

    def draw(below: int) -> int:
        if state["left"] < 32:
            state["x"] = int.from_bytes(hashlib.blake2b(seed + state["n"].to_bytes(4, "big"), key=key[:64]).digest(), "big")
            state["n"] += 1
            state["left"] = 512
        state["x"], r = divmod(state["x"], below << 20)
        state["left"] -= 20 + below.bit_length()
        return r % below

    return draw


def _luhn(d: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10


def _scramble(text: str, draw: Callable[[int], int], hexa: bool = False) -> str:
    out = []
    for c in text:
        if hexa and c in "0123456789abcdef":
            out.append("0123456789abcdef"[draw(16)])
        elif "0" <= c <= "9":
            out.append("0123456789"[draw(10)])
        elif "a" <= c <= "z":
            out.append(chr(97 + draw(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw(26)))
        else:
            out.append(c)
    return "".join(out)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin" if c < 0x250 else "other"


def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """The normal form that replaces a normal form."""
    name = kind.startswith(("given", "surname"))
    draw = _stream(kind.rpartition("_")[0] if name else kind, canon, attempt, key)
    wider = max(0, attempt - WIDER)
    if kind in ("card", "phone", "ssn"):
        out = (canon[0] if kind == "card" else "") + _scramble(canon[kind == "card" :], draw)
        if kind == "card" and not _luhn(canon):
            out = next(x for x in (out[:-1] + str(k) for k in range(10)) if not _luhn(x))
        return out
    if kind == "ip":
        o = canon.split(".")
        fixed = 2 if o[:2] in (["192", "168"], ["169", "254"]) or (o[0] == "172" and 16 <= int(o[1]) < 32) else 1 if o[0] in ("10", "127") else 0
        if fixed and wider:
            o, fixed = ["10"], 1
        free = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]
        return ".".join(o[i] if i < fixed else str(free[draw(len(free))] if i == 0 else draw(256)) for i in range(4))
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2:-1] == ["example"] else 1
        letters = "".join(chr(97 + draw(26)) for _ in range(wider))
        return _scramble(local, draw) + letters + "@" + ".".join([*(_scramble(x, draw) for x in labels[:-kept]), *labels[-kept:]])
    if kind == "secret":
        letters = "".join(chr(97 + draw(6)) for _ in range(attempt - GROW + 8)) if attempt >= GROW else ""
        return _scramble(canon, draw, re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+", canon) is not None) + letters
    _, script, gender = kind.split("_")
    if script == "other":
        start = ord(canon[0]) // 256 * 256
        letters = [chr(x) for x in range(start, start + 256) if chr(x).isalpha()]
        return "".join(letters[draw(len(letters))] for _ in range(len(canon) + wider))
    s = SYLLABLES[script]
    stem = "".join(s[draw(len(s))] for _ in range(3 + attempt // 3))
    return stem + (ENDINGS[script][gender] if kind.startswith("given") else "ов" if script == "cyrillic" else "")


#: Values of a shape (0 for each digit, a for each letter): logarithms of 10 and 26; a card's first digit and check digit are fixed.
def _room(kind: Column, canon: Column) -> tuple[Column, Column]:
    """The shape of an entity of a fixed format, and the logarithm of how many values it has; null for others."""
    private = canon.rlike(r"^(10|127|192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\.")
    shape = F.regexp_replace(F.regexp_replace(canon, "[0-9]", "0"), "[A-Za-z]", "a")
    shape = F.when(kind == "ip", F.when(private, "private").otherwise("public")).when(kind.isin("card", "phone", "ssn", "secret"), shape)
    digits, letters = F.regexp_count(shape, F.lit("0")), F.regexp_count(shape, F.lit("a"))
    # secrets of hexadecimal digits alone draw from 16 values a place
    hexa = (kind == "secret") & canon.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$")
    size = F.when(kind == "ip", F.when(private, math.log(2.0**24)).otherwise(math.log(2.0**31))).when(hexa, F.length(canon) * math.log(16.0))
    return shape, F.coalesce(size, (digits - F.when(kind == "card", 2).otherwise(0)) * math.log(10.0) + letters * math.log(26.0))


def _words_from(text: str, at: int) -> list[tuple[int, str]]:
    """Up to three capitalised words from a place on, before any title; initials are passed over."""
    found: list[tuple[int, str]] = []
    while len(found) < 3:
        m = NEXT_WORD.match(text, at)
        if not m or not m[1][0].isupper() or m[1] in _TITLES:
            break
        word, at = re.sub(r"['’][sS]$", "", m[1]).rstrip("'’-"), m.end()
        if len(word) == 1 and text[at : at + 1] == ".":
            at += 1
            continue
        found.append((m.start(1), word))
    return found


def _name_parts(found: list[tuple[int, str]], gender: str) -> Iterator[tuple[int, int, str, str]]:
    for i, (start, word) in enumerate(found):
        script, canon = script_of(word), word.casefold()
        if i < len(found) - 1:
            g = _KNOWN.get(canon, gender) if gender == "u" else gender
            yield start, start + len(word), f"given_{script}_{g}", canon
        else:
            if script == "cyrillic" and gender == "f" and canon.endswith(("ва", "на")):
                canon = canon[:-1]
            yield start, start + len(word), f"surname_{script}_u", canon


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names after titles and after common given names, and their words wherever else they stand capitalised."""
    got: list[tuple[int, int, str, str]] = []
    if any(t in text for t in _TITLES):
        for m in TITLE.finditer(text):
            got += _name_parts(_words_from(text, m.end()), "m" if m[1] in MALE_TITLES else "f" if m[1] in FEMALE_TITLES else "u")
    for n in _GIVEN:
        at = text.find(n)
        while at >= 0:
            after = at + len(n)
            if not text[at - 1 : at].isalnum() and (found := _words_from(text, after)):
                # one word only: what follows may be another sentence's part
                got += _name_parts([(at, n), found[0]], _KNOWN[n.casefold()])
            at = text.find(n, after)
    if not got:
        return got
    known: dict[str, str] = {}
    for _, _, kind, canon in sorted(got):
        known.setdefault(canon, kind)
    spans = {(a, z) for a, z, _, _ in got}
    for m in WORD.finditer(text):
        if m[0][0].isupper() and m[0] not in _TITLES:
            word = re.sub(r"['’][sS]$", "", m[0]).rstrip("'’-")
            canon = word.casefold()
            if canon not in known and canon.endswith(("ва", "на")) and known.get(canon[:-1], "").startswith("surname_cyrillic"):
                canon = canon[:-1]
            span = m.start(), m.start() + len(word)
            if canon in known and span not in spans:
                got.append((*span, known[canon], canon))
    return got


def _phones(text: str) -> Iterator[tuple[int, int]]:
    """Where phone numbers lie, without their country codes."""
    if "-" in text or "+" in text:
        for m in PHONE.finditer(text):
            yield m.end(1) if m.group(1) else m.start(), m.end()
    if "+" in text:
        for m in INTERNATIONAL.finditer(text):
            ends = [m.start(1) + g.end() for g in re.finditer(r"\d+", m.group(1))]
            head = text[m.start(1) : ends[0]]
            code = COUNTRY.match(head)
            if not code or (len(head) < 4 and code.end() < len(head)):
                continue
            start, n, end = m.start(1) + code.end(), 0, 0
            # groups as long as they can be part of the number: what follows it isn't
            for at in ends:
                n = sum(c.isdigit() for c in text[start:at])
                if n <= (10 if code.group() in "17" else 13 - code.end()) or at == ends[0]:
                    end = at
            n = sum(c.isdigit() for c in text[start:end])
            if 8 <= n + code.end() <= 15 and (code.group() not in "17" or n == 10):
                yield start, end
    if "(" in text:
        for m in BRACKETED.finditer(text):
            yield m.span()
    for m in GROUPED.finditer(text):
        if not m.start() or not (text[m.start() - 1].isdigit() or text[m.start() - 1] == "+"):
            yield m.span()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, apart and in order."""
    got: list[tuple[int, int, str, str]] = []
    digits = re.search(r"[0-9]", text) is not None
    if "@" in text:
        got += [(*m.span(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    low = text.lower() if "=" in text or ":" in text else ""
    if low and any(k in low for k in ("passw", "passphrase", "secret", "token", "key")):
        for m in SECRET.finditer(text):
            v = m.group(1)
            if re.search("[A-Za-z0-9]", v):
                got.append((*m.span(1), "secret", v.lower() if v in (v.lower(), v.upper()) else v))
    if digits:
        for m in IP.finditer(text):
            if all(int(x) < 256 for x in m.groups()):
                got.append((*m.span(), "ip", ".".join(str(int(x)) for x in m.groups())))
        phones = list(_phones(text))
        got += [(a, z, "phone", re.sub(r"\D", "", text[a:z])) for a, z in phones]
        for m in CARD.finditer(text):
            if not (text[max(0, m.start() - 1) : m.start()] == "+" and any(m.start() < a and z == m.end() for a, z in phones)):
                got.append((*m.span(), "card", re.sub(r"\D", "", m.group())))
        for m in SPLIT_CARD.finditer(text):
            d = re.sub(r"\D", "", m.group())
            if not text[max(0, m.start() - 1) : m.start()].isdigit() and not _luhn(d):
                got.append((*m.span(), "card", d))
        if "-" in text:
            got += [(*m.span(), "ssn", re.sub(r"\D", "", m.group())) for m in SSN.finditer(text)]
    got += _names(text)
    got.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for g in got:
        if not out or g[0] >= out[-1][1]:
            out.append(g)
    told = {}
    for _, _, kind, canon in out:
        if kind.startswith("given") and not kind.endswith("_u"):
            told.setdefault((kind[:-2], canon), kind)
    return [(a, z, told.get((kind[:-2], canon), kind) if kind.startswith("given") and kind.endswith("_u") else kind, canon) for a, z, kind, canon in out]


def render(kind: str, seen: str, new: str) -> str:
    """A surrogate's normal form written as the entity was."""
    if kind in ("card", "phone", "ssn"):
        d = iter(new)
        return "".join(next(d) if c.isdigit() else c for c in seen) + "".join(d)
    if kind in ("email", "secret"):
        if kind == "secret" and seen not in (seen.lower(), seen.upper()):
            return new
        if seen == seen.upper() and seen != seen.lower():
            return new.upper()
        return "".join(n.upper() if i < len(seen) and seen[i].isupper() else n for i, n in enumerate(new))
    if kind.startswith(("given", "surname")):
        if kind == "surname_cyrillic_u" and seen.casefold().endswith(("ва", "на")):
            new += "а"
        return new.upper() if len(seen) > 1 and seen == seen.upper() else new[:1].upper() + new[1:]
    return new


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, int]:
    """The text with its surrogates, and how many there are."""
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, canon in found:
        new = surrogate(kind, canon, (attempts or {}).get((kind, canon), 0), key)
        out += [text[at:start], render(kind, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, canon: each entity of each row once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, h, *e) for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text").to_pylist(), strict=True) for e in dict.fromkeys((k, c) for _, _, k, c in find(t or ""))]
            cols = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "text_hash", "kind", "canon"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, "doc_id long, text_hash long, kind string, canon string")


def exceptions(distinct: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt for the entities (distinct kind and canon) that can't take attempt 0.

    Given names of all genders and scripts share one room, as do surnames, and each other kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, c, a = (b.column(x).to_pylist() for x in ("kind", "canon", "attempt"))
            new = [surrogate(*x, key) for x in zip(k, c, a, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "new"])

    shape, size = _room(F.col("kind"), F.col("canon"))
    shapes = distinct.select("kind", "canon", shape.alias("shape"), size.alias("size"))
    full = shapes.filter("shape is not null").groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size")).filter(F.log(F.col("n") * 2) > F.col("size"))
    full = cut(full)
    for r in full.filter("kind <> 'secret'").limit(1).collect():
        raise ValueError(f"{r['n']} distinct entities of kind {r['kind']}, shape {r['shape']!r}, take more than half of its values: no distinct surrogates")
    room = F.substring_index("kind", "_", 1)
    all_ = distinct.select(room.alias("room"), F.col("canon").alias("new")).distinct()
    pending = distinct.withColumn("attempt", F.lit(0))
    if full.limit(1).count():
        grows = full.select("kind", "shape", F.lit(GROW).alias("attempt"))
        pending = shapes.join(grows, ["kind", "shape"], "left").select("kind", "canon", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    taken = None
    while True:
        tried = cut(pending.mapInArrow(run, "kind string, canon string, attempt int, new string").withColumn("room", room))
        ok = tried.join(all_, ["room", "new"], "left_anti")
        if taken is not None:
            ok = ok.join(taken, ["room", "new"], "left_anti")
        first = ok.groupBy("room", "new").agg(F.min(F.struct("kind", "canon")).alias("w")).select("room", "new", "w.kind", "w.canon")
        won = cut(tried.join(first, ["room", "new", "kind", "canon"], "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(tried.join(won, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        if not left.limit(1).count():
            return taken.filter("attempt > 0").select("kind", "canon", "attempt")
        pending = left


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in ``text``, and one more column at the end: the number replaced."""
    spark = docs.sparkSession
    seen = cut(entities(docs))
    odd = cut(exceptions(cut(seen.select("kind", "canon").distinct()), key))
    few = odd.limit(BROADCAST_EXCEPTIONS + 1).count() <= BROADCAST_EXCEPTIONS
    count = fresh("n_replaced", docs.columns)
    wrapped = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("t"))
    if few:
        table = spark.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in odd.collect()})
        wrapped = wrapped.withColumn("own", F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>"))
    else:
        table = None
        own = seen.join(odd, ["kind", "canon"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("own"))
        wrapped = wrapped.withColumns({"i": F.col("row.doc_id").cast("long"), "h": F.xxhash64("t")})
        wrapped = wrapped.join(own, wrapped["i"].eqNullSafe(own["doc_id"]) & (wrapped["h"] == own["text_hash"]), "left").select("row", "t", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, n = [], []
            for t, own in zip(b.column("t").to_pylist(), b.column("own").to_pylist(), strict=True):
                attempts = {(o["kind"], o["canon"]): o["attempt"] for o in own or []} if table is None else table.value
                text, k = (None, 0) if t is None else replace(t, key, attempts)
                new.append(text)
                n.append(k)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string()), pa.array(n, pa.int64())], ["row", "t", "n"])

    others = [c for c in docs.columns if c.lower() != "text"]
    slim = wrapped.select(F.struct(*[F.col(f"row.`{c}`") for c in others] or [F.lit(0).alias("_")]).alias("row"), "t", "own")
    got = slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, t string, n long")
    return got.select(*[(F.col("t") if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.col("n").alias(count))
