"""Keyed, type-consistent surrogates for personal data and secrets.

Every entity is rewritten as a string of the same mask: digits stay digits, vowels vowels, consonants consonants of
the same script and case, signs stay. Letters and digits outside ``CLASSES`` are permuted within their kind in a block
of 256 characters (``block_classes``), or within ``RANGES``; values of signs only are no entities. For each type and mask the rewriting is a keyed permutation without
fixed points (a shift conjugated by a Feistel network over the mask's mixed radix), so different entities
get different surrogates and an entity gets the same one everywhere, whatever its format. Known first names
are permuted within the names of their gender and script.

Surrogates of different masks or types could only meet by way of names from a list. ``collisions`` checks all entities of
the corpus; entities that clash are permuted again with another key (``attempt``) until no two share a
surrogate; from attempt ``CROWDED`` on their surrogates get longer, so that room is never short. Up to
``MOST_CLASHES`` such entities are broadcast; more are joined to the texts that hold them.

Finding and rewriting are done per text inside tasks; only distinct entities are shuffled, for the check. Null texts
stay null, empty ones empty. Every row gives a row with its columns, repeated rows equal results. Columns of the
input named like new ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linefold.llm.store import shared, stage

ROUNDS = 8
MOST_CLASHES = 10_000
#: Attempts after which surrogates of names, secrets and mail addresses get longer.
CROWDED = 8
REMEMBERED = 100_000

#: What finds entities. Signs between the parts of a phone number may be decorated.
PATTERNS = {
    "email": r"[^\W_][\w.%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:token|api[_ \-]?key|secret|password|passwd|access[_ \-]?key)\b\W{0,8}[:=]\W{0,8})(?P<secret>[^\s\"'`<>,;|!#$%&*]{6,})",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bsk-[A-Za-z0-9]{20,}\b|\b(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[^\w\n+]{0,6}\d{1,4}(?:[^\w\n+]{1,6}\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?!\d)",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
}
#: Forms of address and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: First names by script and gender.
NAMES = {
    ("latin", "m"): "James John Robert Michael David Thomas Peter Paul Hans Karl Pierre Louis Carlos Miguel Juan Pedro".split(),
    ("latin", "f"): "Mary Anna Linda Susan Sarah Julia Emma Laura Ingrid Petra Marie Claire Carmen Lucia Elena Sofia".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
}
#: Letters that replace each other.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
]
CLASS_OF = {c: letters for letters in CLASSES for c in letters}
#: First and last character of large classes.
RANGES = {"han": ("\u4e00", "\u9fa5"), "hangul": ("\uac00", "\ud7a3")}
#: Classes of the blocks seen so far.
BLOCKS: dict[int, dict[str, str]] = {}

#: What stays of a host: a reserved domain, or else the last label.
RESERVED = re.compile(r"(.*?)(\.?example\.(?:com|org|net)|\.[^.]+)$")

FIND = {kind: re.compile(p) for kind, p in PATTERNS.items()}
CAPITAL = r"[^\W\d_a-zа-яα-ωß-öø-ÿ][^\W\d_]+"
PERSON = re.compile(rf"\b({'|'.join(TITLES)})\b\.?[ \u00a0]+({CAPITAL}(?:[ \u00a0-]{CAPITAL}){{0,2}})")
GENDER = {name: place for place, names in NAMES.items() for name in names}
NAMED = re.compile(rf"\b({'|'.join(GENDER)})((?: {CAPITAL}){{1,2}})")
WORD = re.compile(r"[^\W\d_]+")


def block_classes(block: int) -> dict[str, str]:
    """Classes of letters and digits of 256 characters: of one kind, case and form. Kinds of one character are put together."""
    groups: dict[tuple, str] = {}
    for c in map(chr, range(block << 8, block + 1 << 8)):
        kind = unicodedata.category(c)
        if c.isalnum() and c.lower() == c and c not in CLASS_OF and c != "ς":
            turns = c.upper() != c and c.upper().lower() == c and len(c.upper()) == 1
            at = (kind, turns, unicodedata.normalize("NFKC", c) == c, *unicodedata.name(c, "").split()[:2])
            groups[at] = groups.get(at, "") + c
    for size in (1, 3, 0):  # ever wider kinds for characters that are alone in theirs
        for at in [a for a, letters in groups.items() if len(letters) == 1]:
            letters = groups.pop(at)
            groups[at[:size]] = groups.get(at[:size], "") + letters
    if len(groups.get((), "")) == 1 and len(groups) > 1:
        alone = groups.pop(())
        groups[max(groups, key=lambda a: len(groups[a]))] += alone
    return {c: letters for letters in groups.values() if len(letters) > 1 for c in letters}


def class_of(char: str) -> str:
    """The lower-case letters or digits that may stand for ``char``, or the name of their range; empty if it stays."""
    low = char.lower()
    if low in CLASS_OF:
        return CLASS_OF[low]
    if char.isascii():
        return ""
    for name, (first, last) in RANGES.items():
        if first <= char <= last:
            return name
    low = low if len(low) == 1 else char
    block = ord(low) >> 8
    if block not in BLOCKS:
        BLOCKS[block] = block_classes(block)
    return BLOCKS[block].get(low, "")


def radix(letters: str) -> int:
    return ord(RANGES[letters][1]) - ord(RANGES[letters][0]) + 1 if letters in RANGES else len(letters)


def digit_of(char: str, letters: str) -> int:
    return ord(char) - ord(RANGES[letters][0]) if letters in RANGES else letters.index(char.lower())


def char_of(digit: int, letters: str, like: str) -> str:
    if letters in RANGES:
        return chr(ord(RANGES[letters][0]) + digit)
    out = letters[digit]
    return out.upper() if like != like.lower() and len(out.upper()) == 1 else out


class Permutation:
    """Keyed, without fixed points, on 0 .. a * b - 1."""

    def __init__(self, key: bytes, tweak: str, a: int, b: int) -> None:
        self.key, self.tweak, self.a, self.b = key, tweak.encode(), a, b
        self.size = a * b
        self.shift = 1 + self.number(b"shift", 0) % (self.size - 1) if self.size > 1 else 0

    def number(self, what: bytes, value: int) -> int:
        need = (self.size.bit_length() + 7) // 8 + 8
        data = b"|".join((self.key, self.tweak, what, str(value).encode()))
        return int.from_bytes(hashlib.shake_128(data).digest(need), "big")

    def forth(self, value: int) -> int:
        x, y = divmod(value, self.b)
        for i in range(ROUNDS):
            x = (x + self.number(b"x%d" % i, y)) % self.a
            y = (y + self.number(b"y%d" % i, x)) % self.b
        return x * self.b + y

    def back(self, value: int) -> int:
        x, y = divmod(value, self.b)
        for i in reversed(range(ROUNDS)):
            y = (y - self.number(b"y%d" % i, x)) % self.b
            x = (x - self.number(b"x%d" % i, y)) % self.a
        return x * self.b + y

    def __call__(self, value: int) -> int:
        return self.forth((self.back(value) + self.shift) % self.size)


def permuted(key: bytes, kind: str, text: str) -> str:
    """``text`` with its letters and digits permuted within their classes; one of no classes stays."""
    classes = [class_of(c) for c in text]
    at = [i for i, c in enumerate(classes) if c]
    middle = len(at) // 2
    sizes = [1, 1]
    for n, i in enumerate(at):
        sizes[n >= middle] *= radix(classes[i])
    mask = "".join(f"<{c}>" if c else t.lower() for c, t in zip(classes, text, strict=True))
    value = 0
    for i in at:
        value = value * radix(classes[i]) + digit_of(text[i], classes[i])
    value = Permutation(key, f"{kind}|{mask}", *sizes)(value) if at else 0
    out = list(text)
    for i in reversed(at):
        value, digit = divmod(value, radix(classes[i]))
        out[i] = char_of(digit, classes[i], text[i])
    return "".join(out)


@dataclass(frozen=True)
class Entity:
    kind: str
    canonical: str
    start: int
    stop: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[Entity]:
    """Entities of a text, in order and apart from each other; earlier kinds win."""
    found: list[Entity] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, canonical: str, start: int, stop: int) -> None:
        if any(map(class_of, canonical)) and all(stop <= a or b <= start for a, b in taken):
            taken.append((start, stop))
            found.append(Entity(kind, canonical, start, stop))

    digits = any(c in text for c in "0123456789")
    for kind, pattern in FIND.items():
        if (kind == "email" and "@" not in text) or (not digits and kind not in ("email", "secret", "key")):
            continue
        for m in pattern.finditer(text):
            group = "secret" if kind == "secret" else 0
            value = m.group(group)
            if kind in ("phone", "card", "ssn"):
                value = re.sub(r"\D", "", value)
            elif kind == "iban":
                value = value.replace(" ", "")
            add("secret" if kind == "key" else kind, value.lower(), *m.span(group))
    people: dict[str, str] = {}
    for m in PERSON.finditer(text):
        for part in WORD.findall(m.group(2)):
            people.setdefault(part, TITLES[m.group(1)])
    for m in NAMED.finditer(text):
        for part in WORD.findall(m.group(0)):
            people.setdefault(part, "")
    if people:
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, people))})\b", text):
            add("person", m.group().lower(), *m.span())
    return sorted(found, key=lambda e: e.start)


LISTED = {name.lower(): (place, i) for place, names in NAMES.items() for i, name in enumerate(names)}


def replacement(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """The surrogate of an entity's canonical form."""
    key = key + b"|%d" % attempt
    if attempt > CROWDED and kind in ("person", "secret", "email"):
        first = next(c for c in canonical if class_of(c))
        canonical = first * (attempt - CROWDED) + canonical
    if kind == "person" and canonical in LISTED:
        place, i = LISTED[canonical]
        return NAMES[place][Permutation(key, f"name|{place}", 1, len(NAMES[place]))(i)].lower()
    if kind == "phone" and len(canonical) > 10:  # the country stays
        return canonical[:-10] + permuted(key, kind, canonical[-10:])
    if kind == "ip":
        value = 0
        for part in canonical.split("."):
            value = value * 256 + int(part)
        value = Permutation(key, kind, 1 << 16, 1 << 16)(value)
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "email":
        name, _, host = canonical.partition("@")
        labels, end = RESERVED.match(host).groups()
        return f"{permuted(key, 'name', name)}@{permuted(key, 'host', labels)}{end}"
    if kind == "iban":
        return canonical[:2] + permuted(key, kind, canonical[2:])
    if kind == "card":
        out = permuted(key, kind, canonical)
        while luhn(out) != luhn(canonical):  # walking on stays a permutation of either kind
            out = permuted(key, kind, out)
        return out
    if kind == "secret" and re.fullmatch("[0-9a-f]+", canonical):
        value, half = int(canonical, 16), len(canonical) // 2
        value = Permutation(key, f"hex|{len(canonical)}", 16**half, 16 ** (len(canonical) - half))(value)
        return f"{value:0{len(canonical)}x}"
    return permuted(key, kind, canonical)


def dressed(surrogate: str, kind: str, mention: str) -> str:
    """The surrogate in the format of a mention: its case and the signs between digits."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(surrogate)
        out = [next(rest, "") if c.isalnum() else c for c in mention]
        surrogate = "".join(out)
    if mention.isupper():
        return surrogate.upper()
    if len(surrogate) == len(mention):
        return "".join(s.upper() if m.isupper() else s for s, m in zip(surrogate, mention, strict=True))
    return surrogate.capitalize() if mention[:1].isupper() else surrogate


class Rewriter:
    def __init__(self, key: bytes, attempts: dict[tuple[str, str], int]) -> None:
        self.key, self.attempts = key, attempts
        self.known: dict[tuple[str, str, int], str] = {}

    def surrogate(self, kind: str, canonical: str, attempt: int) -> str:
        at = (kind, canonical, attempt)
        if (out := self.known.get(at)) is None:
            out = replacement(self.key, *at)
            if len(self.known) < REMEMBERED:
                self.known[at] = out
        return out

    def rewrite(self, text: str, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, Counter]:
        """The text with surrogates and its entities by kind. ``attempts``: those of this text, in place of the common ones."""
        attempts = self.attempts if attempts is None else attempts
        out, at, kinds = [], 0, Counter()
        for e in find(text):
            mention = text[e.start : e.stop]
            surrogate = self.surrogate(e.kind, e.canonical, attempts.get((e.kind, e.canonical), 0))
            out += [text[at : e.start], dressed(surrogate, e.kind, mention)]
            at = e.stop
            kinds[e.kind] += 1
        return "".join([*out, text[at:]]), kinds


def entities(docs: DataFrame, key: bytes, attempts: dict, text_column: str = "text") -> DataFrame:
    """(kind, canonical, surrogate) of all distinct entities. The table is for the check and is not a result."""

    def run(batches):
        writer = Rewriter(key, attempts)
        for batch in batches:
            found = {(e.kind, e.canonical) for t in batch.column(0) if t.as_py() for e in find(t.as_py())}
            rows = [(k, c, writer.surrogate(k, c, attempts.get((k, c), 0))) for k, c in sorted(found)]
            arrays = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "canonical", "surrogate"])

    rows = docs.select(F.col(text_column).cast("string"))
    return rows.mapInArrow(run, "kind string, canonical string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """(kind, canonical) of entities whose surrogate an entity before them has, or that kept their own."""
    first = found.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
    clash = (F.col("canonical") != F.col("first")) | (F.col("canonical") == F.col("surrogate"))
    return found.join(first, ["kind", "surrogate"]).where(clash).select("kind", "canonical")


def again(clashes: DataFrame, key: bytes, attempt: int) -> DataFrame:
    """(kind, canonical, surrogate, attempt) of entities under another key."""

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            new = pa.array([replacement(key, k, c, attempt) for k, c in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], ["kind", "canonical", "surrogate"])

    found = clashes.mapInArrow(run, "kind string, canonical string, surrogate string")
    return found.withColumn("attempt", F.lit(attempt))


def attempts_for(docs: DataFrame, key: bytes, text_column: str) -> dict[tuple[str, str], int] | DataFrame:
    """Entities that need another key than the first, and which: (kind, canonical, attempt), as a dictionary if they are few."""
    found = stage(entities(docs, key, {}, text_column).withColumn("attempt", F.lit(0)), "entities")
    attempt, clashes = 0, stage(collisions(found), "clashes")
    while not clashes.isEmpty():
        attempt += 1
        kept = found.join(clashes, ["kind", "canonical"], "left_anti")
        found = stage(kept.unionByName(again(clashes, key, attempt)), "entities")
        clashes = stage(collisions(found), "clashes")
    found = found.where("attempt > 0").select("kind", "canonical", "attempt")
    few = found.limit(MOST_CLASHES + 1).collect()
    return {(r.kind, r.canonical): r.attempt for r in few} if len(few) <= MOST_CLASHES else found


def with_attempts(docs: DataFrame, attempts: DataFrame, text_column: str) -> DataFrame:
    """``docs`` and, last, the ``attempts`` of the entities in their text."""
    mark, held = "mark of the text", "attempts of the text"
    docs = docs.withColumn(mark, F.sha2(F.col(text_column).cast("string").cast("binary"), 256))

    def run(batches):
        for batch in batches:
            rows = set()
            for m, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows |= {(m, e.kind, e.canonical) for e in find(t.as_py() or "")}
            arrays = [pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays(arrays, [mark, "kind", "canonical"])

    texts = docs.select(mark, F.col(text_column).cast("string"))
    found = texts.mapInArrow(run, f"`{mark}` string, kind string, canonical string").distinct()
    found = found.join(attempts, ["kind", "canonical"])
    found = found.groupBy(mark).agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(held))
    return docs.join(stage(found, "attempts"), mark, "left").drop(mark)


def pseudonymised(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``docs`` with entities in the text replaced, ``n_entities`` and ``kinds`` (name=count, ordered)."""
    docs = docs.drop("n_entities", "kinds")
    secret = key.encode()
    attempts = attempts_for(docs, secret, text_column)
    joined = not isinstance(attempts, dict)
    held = shared(docs.sparkSession, (secret, {} if joined else attempts))
    place, many = docs.columns.index(text_column), len(docs.columns)
    fields = [*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType())]
    names = [f.name for f in fields]

    def run(batches):
        writer = Rewriter(*held())
        for batch in batches:
            texts, counts, kinds = [], [], []
            for i, text in enumerate(batch.column(place)):
                text = text.as_py()
                own = {(a["kind"], a["canonical"]): a["attempt"] for a in batch.column(many)[i].as_py() or []} if joined else None
                new, found = writer.rewrite(text, own) if text else (text, Counter())
                texts.append(new)
                counts.append(sum(found.values()))
                kinds.append(",".join(f"{k}={n}" for k, n in sorted(found.items())))
            columns = list(batch.columns[:many])
            columns[place] = pa.array(texts, pa.string())
            arrays = [*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = with_attempts(docs, attempts, text_column) if joined else docs
    return rows.mapInArrow(run, T.StructType(fields))
