"""Replacement of personal data by keyed surrogates.

Entities are e-mail addresses, phone numbers, IP addresses, card and other long numbers, secrets in
hexadecimal, and names after a form of address. A surrogate is drawn with HMAC from the key, the
entity's type, its canonical value and an attempt number, and keeps the form: digits for digits with
the same separators, a valid check digit for valid cards, the letter case, the domain's ending, the
script of a name and the gender its form of address shows. Equal canonical values get equal
surrogates everywhere (coreference). All surrogates of the corpus are then checked: of entities with
one surrogate all but one try again, as does a surrogate that is itself an entity of the corpus, until
none collide (distinctness).

Results for odd input: null texts stay null and have no entities; texts without entities stay as they
are; repeated rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, row_key, stored

# Forms of address by gender.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"]
OTHER_TITLES = ["Dr", "Prof"]
# Syllables and endings that made-up names consist of.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te to va ve vi".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те то ва ве ви".split(),
}
ENDINGS = {
    ("latin", "female"): ["na", "ria", "lia", "sa"], ("latin", "male"): ["rd", "mon", "nas", "ton"],
    ("latin", "any"): ["ly", "ry", "nel", "rin"], ("latin", "family"): ["son", "mann", "ley", "rez", "ard", "ner"],
    ("cyrillic", "female"): ["на", "рия", "лия", "са"], ("cyrillic", "male"): ["мон", "нас", "тон", "рд"],
    ("cyrillic", "any"): ["ли", "ри", "ра", "ла"], ("cyrillic", "family"): ["ко", "ев", "ин", "ук"],
}
# Wider than the patterns below: digits of any script, also such as Java doesn't know yet, and no word boundaries, on which Java and Python differ.
_DIGIT = r"[\p{Nd}\p{Cn}]"
HINT = (rf"@|{_DIGIT}[\p{{Nd}}\p{{Cn}} .()-]{{6,}}{_DIGIT}|{_DIGIT}{{1,3}}(?:\.{_DIGIT}{{1,3}}){{3}}|[0-9a-fA-F]{{24}}"
        r"|(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + r")\.?[ \t]")

_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{24,}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)")),
    ("number", re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{3,4}(?!\w|[.-]\d)"
                         r"|(?<![\w.])\+\d{8,14}(?!\w)")),
]
TITLED = re.compile(r"\b(?:(?P<female>%s)|(?P<male>%s)|(?P<any>%s))\b\.?[ \t]+(?P<names>%s(?:[ \t]+%s)?)" % (
    "|".join(FEMALE_TITLES), "|".join(MALE_TITLES), "|".join(OTHER_TITLES), _NAME, _NAME))


def _script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def canonical(kind: str, found: str) -> str:
    """The value that spellings of one entity share."""
    if kind == "phone" and (code := re.match(r"\+\d{1,3}(?=[ .(-])", found)):
        return code.group() + " " + re.sub(r"\D", "", found[code.end():])
    if kind in ("number", "phone"):
        return re.sub(r"[^\d+]", "", found)
    return found.lower() if kind != "ip" else found


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, type, canonical value)`` without overlaps, in order."""
    spans, taken = [], []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if all(m.end() <= s or m.start() >= e for s, e in taken):
                spans.append((m.start(), m.end(), kind, canonical(kind, m.group())))
        taken = [(s, e) for s, e, _, _ in spans]
    for m in TITLED.finditer(text):
        start, names = m.start("names"), m.group("names").split()
        names = names[:1] if not names[0][0].isupper() else [n for n in names if n[0].isupper()]
        if not names[0][0].isupper():
            continue
        place, gender = start, next(g for g in ("female", "male", "any") if m.group(g))
        for k, name in enumerate(names):
            place = text.index(name, place)
            kind = "family" if k == len(names) - 1 else gender
            if all(place + len(name) <= s or place >= e for s, e in taken):
                spans.append((place, place + len(name), f"{kind} name", name.lower()))
            place += len(name)
    return sorted(spans)


class Stream:
    """Reproducible choices from a key and a label."""

    def __init__(self, key: bytes, *label: str):
        self.key, self.label, self.count, self.bytes = key, "\0".join(label).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, self.label + b"\0%d" % self.count, hashlib.sha256).digest()
            self.count += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return value % n


def luhn(digits: str) -> bool:
    doubled = [int(c) for c in reversed(digits)]
    return sum(doubled[0::2] + [sum(divmod(2 * x, 10)) for x in doubled[1::2]]) % 10 == 0


def _letters(word: str, draw: Stream) -> str:
    kinds = (("0123456789", str.isdigit), ("aeiou", lambda c: c in "aeiou"), ("bcdfghjklmnprstvwz", str.isalpha))
    return "".join(next((k[draw.below(len(k))] for k, test in kinds if test(c)), c) for c in word)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical surrogate of a canonical value."""
    draw = Stream(key, kind, value, str(attempt))
    if kind == "email":
        local, domain = value.split("@", 1)
        labels = domain.split(".")
        of_domain = Stream(key, "domain", domain)  # one domain stays one domain, whatever the attempt
        kept = 2 if len(labels) > 2 else 1
        return _letters(local, draw) + "@" + ".".join([_letters(x, of_domain) for x in labels[:-kept]] + labels[-kept:])
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "secret":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    if kind == "number":
        body = "".join(str(draw.below(10)) for _ in value[:-1])
        last = next(d for d in "0123456789" if luhn(body + d))
        return body + (last if luhn(value) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "phone":
        code, blank, rest = value.rpartition(" ")
        return code + blank + "".join(str(draw.below(10)) if c.isdigit() else c for c in rest)
    script, gender = _script(value), kind.split()[0]
    parts = SYLLABLES[script]
    name = "".join(parts[draw.below(len(parts))] for _ in range(2 + min(attempt, 4)))
    ends = ENDINGS[script, gender]
    return name + ends[draw.below(len(ends))]


def in_form(found: str, kind: str, value: str) -> str:
    """A canonical surrogate in the spelling of the text it replaces."""
    if kind in ("number", "phone"):
        digits = iter(re.sub(r"\D", "", value))
        return "".join(next(digits) if c.isdigit() else c for c in found)
    if found.isupper():
        return value.upper()
    if kind.endswith("name"):
        return value[0].upper() + value[1:]
    if len(value) == len(found):
        return "".join(v.upper() if f.isupper() else v for f, v in zip(found, value))
    return value


def entity_spans(docs: DataFrame) -> DataFrame:
    """One row per entity of ``(key_id, key_text, text)`` rows, exact repeats of a row counted once."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, t, *span) for i, t, text in zip(part["key_id"], part["key_text"], part["text"]) for span in find_entities(text)]
            yield pd.DataFrame(rows, columns=["key_id", "key_text", "start", "stop", "kind", "value"])

    return docs.mapInPandas(scan, "key_id string, key_text long, start int, stop int, kind string, value string").distinct()


def surrogate_table(entities: DataFrame, key: bytes, most_rounds: int = 40) -> DataFrame:
    """``(kind, value, surrogate)`` with distinct surrogates, none an entity of its own kind."""

    @F.pandas_udf("string")
    def draw(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *x) for x in zip(kind, value, attempt)], dtype=object)

    entities = stored(entities.select("kind", "value").distinct(), "entities")
    open_, done = entities.withColumn("attempt", F.lit(0)), None
    for _ in range(most_rounds):
        tried = stored(open_.withColumn("surrogate", draw("kind", "value", "attempt")), "tried")
        real = entities.select("kind", F.col("value").alias("surrogate"))
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        owners = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        won = stored(owners.select("kind", "value", "surrogate"), "won")
        done = won if done is None else done.union(won)
        open_ = tried.join(won.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {most_rounds} rounds")


def replace_entities(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with the text rewritten; ``pii_spans`` lists type and place in the new text."""
    names = docs.columns
    rows = docs.withColumn("pii_key", F.struct(*row_key(doc_id, text)))
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    suspects = rows.filter(hinted)
    spans = stored(entity_spans(suspects.select("pii_key.*", F.col(text).alias("text"))), "spans")
    named = spans.join(surrogate_table(spans, key.encode()), ["kind", "value"])
    per_row = named.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("pii_found"))
    per_row = per_row.select(F.struct(*KEY).alias("pii_key"), "pii_found")

    @F.pandas_udf("text string, spans array<struct<kind:string,start:int,stop:int>>")
    def rewrite(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for value, places in zip(texts, found):
            pieces, at, length, marks = [], 0, 0, []
            for p in places if places is not None else ():
                new = in_form(value[p["start"]:p["stop"]], p["kind"], p["surrogate"])
                pieces += [value[at:p["start"]], new]
                length += p["start"] - at
                marks.append({"kind": p["kind"], "start": length, "stop": length + len(new)})
                length, at = length + len(new), p["stop"]
            out.append(("".join(pieces) + value[at:], marks))
        return pd.DataFrame(out, columns=["text", "spans"])

    changed = suspects.join(per_row, "pii_key", "left").withColumn("pii_new", rewrite(F.col(text), F.col("pii_found")))
    changed = changed.select(*[F.col("pii_new.text").alias(n) if n == text else F.col(n) for n in names], F.col("pii_new.spans").alias("pii_spans"))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return rows.filter(~hinted).select(*names, none.alias("pii_spans")).unionByName(changed)
