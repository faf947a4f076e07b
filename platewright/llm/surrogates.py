"""Personal data replaced by keyed surrogates of the same kind and format.

Every kind of entity has a permutation of its own domain, keyed by a secret: digits map to digits, vowels to vowels,
a woman's name to a woman's name of the same script. Equal entities, however they are spaced, get the same
surrogate everywhere without any shared state, and different ones never get the same; a distributed check holds the
result against that promise.
"""

from __future__ import annotations

import hmac
import math
import sys
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm.store import saved

ROUNDS = 8
# Given names by script and gender; letters by script and sound; titles by gender.
GIVEN = {
    ("latin", "f"): """Anna Maria Sofia Emma Laura Julia Sarah Elena Clara Marie Lucia Carmen Alice Jane Mary Linda Susan Karen
Lisa Nancy Ingrid Greta Helga Ursula Claire Camille Chloé Amélie Isabel Pilar""".split(),
    ("latin", "m"): """John James Robert Michael William David Thomas Peter Paul Mark George Henry Jack Daniel Martin Hans Karl
Otto Jürgen Stefan Pierre Jean Louis François Michel José Juan Carlos Miguel Diego""".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Юлия Екатерина Дарья Полина".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Борис Олег Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Κατερίνα Ειρήνη Δήμητρα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Πέτρος Ανδρέας".split(),
}
TITLES = {
    "m": "Mr Herr Monsieur Señor Sr Sir г-н κ".split(),
    "f": "Mrs Ms Miss Frau Madame Mademoiselle Señora Señorita Sra Lady г-жа κα".split(),
    "x": "Dr Prof Doctor Professor Doktor Docteur Доктор".split(),
}
LETTERS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñšžýč",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ёъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
)
DIGITS = "0123456789"
CLASS = {ch: group for group in (*LETTERS, DIGITS) for ch in group}
NAME_GENDER = {n.lower(): key for key, names in GIVEN.items() for n in names}

_WORD = r"[\p{Lu}][\p{L}]+(?:-[\p{Lu}][\p{L}]+)?"
_TITLED = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_KNOWN = "|".join(sorted((n for ns in GIVEN.values() for x in ns for n in (x, x.upper())), key=len, reverse=True))
NAME = regex.compile(
    rf"\b(?:(?P<title>{_TITLED})\.?[  ]+(?P<first>{_WORD})(?:[  ]+(?P<last>{_WORD}))?"
    rf"|(?P<given>{_KNOWN})[  ]+(?P<family>{_WORD}))\b"
)
# Matched backwards from the @, to the start of the mailbox however long it is.
LOCAL = regex.compile(r"(?r)[\p{L}\p{M}\p{N}._%+-]+")
DOMAIN = regex.compile(r"[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)+")
IBAN = regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
# A stretch that may hold numbers, and the numbers in it; the first kind that fits a place is taken.
STRETCH = regex.compile(r"[+(]?\d[\d ().-]*\d")
NUMBER = regex.compile(
    r"(?<![\p{L}\p{N}_@/.-])(?:"
    r"(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.\d))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<card>[3-6]\d{3}(?:([ -]?)\d{4}\4\d{4}\4\d{1,7}|([ -])\d{6}\5\d{5}|\d{9,15}))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\7\d{4})"
    r")(?![\p{L}\p{N}_@]|-\d)"
)


@cache
def other_classes() -> dict[str, str]:
    """Classes of all letters and digits that LETTERS and DIGITS leave out.

    By script (the first word of the character's name), category, whether upper case comes back as it was, and plane.
    A character alone in its class joins the others alone in theirs of its category. The final sigma is a form of a letter and stays.
    """
    groups: dict[tuple, list[str]] = defaultdict(list)
    for n in range(128, sys.maxunicode + 1):
        ch = chr(n)
        kind = unicodedata.category(ch)
        if kind[0] not in "LN" or ch in CLASS or ch == "ς" or ch.lower() != ch and len(ch.lower()) == 1:
            continue
        back = len(ch.upper()) == 1 and ch.upper().lower() == ch
        script = unicodedata.name(ch, "").split(" ")[0].split("-")[0]
        # The ideographic zero has no other of its category.
        groups[("CJK", "Lo", back, 0) if ch == "〇" else (script, kind, back, n >> 16)].append(ch)
    joined: dict[tuple, list[str]] = defaultdict(list)
    for key, chars in groups.items():
        joined[key if len(chars) > 1 else key[1:2]] += chars
    return {ch: group for chars in joined.values() for group in ["".join(chars)] for ch in chars}


def class_of(ch: str) -> str | None:
    """The characters that may stand for ``ch``; None if it is neither letter nor digit."""
    return CLASS.get(ch) or (other_classes().get(ch) if ch > "\x7f" else None)


class Keyed:
    """Permutations of integer domains under a secret key."""

    def __init__(self, secret: bytes):
        self.secret = secret

    def _word(self, label: str, i: int, x: int) -> int:
        return int.from_bytes(hmac.new(self.secret, f"{label}|{i}|{x}".encode(), sha256).digest(), "big")

    def permute(self, label: str, value: int, left: int, right: int) -> int:
        """A permutation of [0, left * right): alternating keyed additions to the two parts."""
        a, b = divmod(value, right)
        for i in range(ROUNDS):
            if i % 2:
                b = (b + self._word(label, i, a)) % right
            else:
                a = (a + self._word(label, i, b)) % left
        return a * right + b

    def _undo(self, label: str, value: int, left: int, right: int) -> int:
        """The inverse of ``permute``."""
        a, b = divmod(value, right)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                b = (b - self._word(label, i, a)) % right
            else:
                a = (a - self._word(label, i, b)) % left
        return a * right + b

    def within(self, label: str, value: int, left: int, right: int, allowed: Callable[[int], bool]) -> int:
        """A permutation of the values that are allowed which leaves none in place, unless it is the only one.

        The keyed permutation puts the values in a circle, and each goes to the next allowed one there.
        """
        size = left * right
        place = self._undo(label, value, left, right)
        while True:
            place = (place + 1) % size
            out = self.permute(label, place, left, right)
            if allowed(out):
                return out

    def text(self, label: str, text: str, allowed: Callable[[str], bool] = lambda t: True) -> str:
        """Characters become others of their class in place: vowels, consonants, letters of a script or digits.

        What has no class stays; upper case is put back where it was.
        """
        low = "".join(x if len(x := ch.lower()) == 1 else ch for ch in text)
        groups = [class_of(ch) for ch in low]
        at = [i for i, g in enumerate(groups) if g]
        half = len(at) // 2
        size = lambda part: math.prod(len(groups[i]) for i in part)
        left, right = size(at[:half]), size(at[half:])
        # Texts of one pattern share a domain; the pattern is part of the label, so patterns do not interact.
        known = (*LETTERS, DIGITS)
        name = lambda g: str(known.index(g)) if g in known else g[0]
        pattern = "".join(name(g) + "," if g else ch for ch, g in zip(low, groups, strict=True))

        def decode(n: int) -> str:
            out = list(low)
            for i in reversed(at):
                n, r = divmod(n, len(groups[i]))
                out[i] = groups[i][r]
            return "".join(out)

        n = 0
        for i in at:
            n = n * len(groups[i]) + groups[i].index(low[i])
        new = decode(self.within(f"{label}:{pattern}", n, left, right, lambda k: allowed(decode(k))))
        return "".join(b.upper() if a.isupper() else b for a, b in zip(text, new, strict=True))

    def digits(self, label: str, value: str, allowed: Callable[[str], bool] = lambda t: True) -> str:
        n = len(value)
        left, right = 10 ** (n // 2), 10 ** (n - n // 2)
        return f"{self.within(f'{label}:{n}', int(value), left, right, lambda k: allowed(f'{k:0{n}d}')):0{n}d}"


def luhn(number: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(number)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _address(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def _network(n: int) -> str:
    """Kinds of addresses that a surrogate keeps."""
    first = n >> 24
    if first == 10 or n >> 20 == 0xAC1 or n >> 16 == 0xC0A8:
        return "private"
    return "special" if first in (0, 127) or first >= 224 else "public"


def _iban_check(country: str, rest: str) -> str:
    spelled = "".join(str(int(ch, 36)) for ch in rest + country + "00")
    return f"{98 - int(spelled) % 97:02d}"


def canonical(kind: str, surface: str) -> str:
    """What makes two mentions the same entity: case and separators do not, nor a leading +1."""
    if kind in ("card", "phone", "ssn"):
        digits = "".join(ch for ch in surface if ch.isdigit())
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return surface.replace(" ", "")
    return surface if kind == "ip" else surface.lower()


def surrogate(keyed: Keyed, kind: str, entity: str) -> str:
    """The replacement of a canonical entity, itself canonical. One to one within a kind."""
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        names = [keyed.text("domain", x) for x in labels[:-1]]
        return keyed.text("mailbox", local) + "@" + ".".join([*names, labels[-1]])
    if kind == "ip":
        kept = _network(_address(entity))
        n = keyed.within("ip", _address(entity), 1 << 16, 1 << 16, lambda k: _network(k) == kept)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        valid, head = luhn(entity), entity[0]
        return head + keyed.digits(f"card{head}", entity[1:], lambda d: luhn(head + d) == valid)
    if kind == "phone":
        return keyed.digits("phone", entity, lambda d: (d[0] in "01") == (entity[0] in "01"))
    if kind == "ssn":
        sound = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        return keyed.digits("ssn", entity, lambda d: sound(d) == sound(entity))
    if kind == "iban":
        country, rest = entity[:2], entity[4:]
        new = keyed.text(f"iban{country}", rest)
        # A mention whose check digits do not fit keeps its own way of being wrong.
        shift = (int(entity[2:4]) - int(_iban_check(country, rest))) % 100
        return country + f"{(int(_iban_check(country, new)) + shift) % 100:02d}" + new
    if kind.startswith("given"):
        if entity in NAME_GENDER:
            names = sorted(n.lower() for n in GIVEN[NAME_GENDER[entity]])
            k = names.index(entity)
            half = math.isqrt(len(names)) + 1
            return names[keyed.within(f"given{NAME_GENDER[entity]}", k, half, half, lambda i: i < len(names))]
        return keyed.text("given", entity, lambda t: t not in NAME_GENDER)
    return keyed.text("family", entity)


def render(kind: str, surface: str, new: str) -> str:
    """The surrogate in the surface form of a mention: separators, country code and case stay."""
    if kind in ("card", "phone", "ssn"):
        places = [i for i, ch in enumerate(surface) if ch.isdigit()]
        out = list(surface)
        for i, ch in zip(reversed(places), reversed(new), strict=False):
            out[i] = ch
        return "".join(out)
    if kind == "iban":
        it = iter(new)
        return "".join(ch if ch == " " else next(it) for ch in surface)
    if kind == "ip":
        return new
    if surface.isupper() and len(surface) > 1:
        return new.upper()
    if len(new) == len(surface):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(surface, new, strict=True))
    return new[:1].upper() + new[1:] if surface[:1].isupper() else new


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, in order and without overlap; earlier kinds of the list win a stretch."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        before = LOCAL.match(text, 0, at)
        after = DOMAIN.match(text, at + 1)
        if before and after:
            found.append((before.start(), after.end(), "email"))
        at = text.find("@", at + 1)
    found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text)]
    for stretch in STRETCH.finditer(text):
        if stretch.end() - stretch.start() > 6:
            # One character more on the right, as what follows decides where a number ends.
            for m in NUMBER.finditer(text, stretch.start(), min(len(text), stretch.end() + 1)):
                found.append((m.start(), m.end(), m.lastgroup))
    for m in NAME.finditer(text):
        gender = next((g for g, ts in TITLES.items() if m["title"] in ts), "x")
        if m["title"] and not m["last"]:
            # One word after a title is a family name unless it is a known given name.
            group, kind = "first", f"given_{gender}" if m["first"].lower() in NAME_GENDER else "family"
            found.append((*m.span(group), kind))
        else:
            first, last = ("first", "last") if m["title"] else ("given", "family")
            found += [(*m.span(first), f"given_{gender}"), (*m.span(last), "family")]
    return _apart(found + _later_mentions(text, _apart(found)))


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out.append((s, e, kind))
            end = e
    return out


SHORTEST_MENTION = 3


def _later_mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where a name found in this text stands alone: the given or the family name as it was written, or in capitals."""
    names: dict[str, str] = {}
    for s, e, kind in found:
        if (kind == "family" or kind.startswith("given")) and e - s >= SHORTEST_MENTION:
            for form in (text[s:e], text[s:e].upper()):
                names.setdefault(form, kind)
    if not names:
        return []
    forms = "|".join(regex.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    alone = regex.compile(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_@.-])(?:{forms})(?![\p{{L}}\p{{M}}\p{{N}}_@]|[-.][\p{{L}}\p{{N}}])")
    starts, out = [s for s, _, _ in found], []
    for m in alone.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if (k < 0 or found[k][1] <= m.start()) and (k + 1 == len(found) or found[k + 1][0] >= m.end()):
            out.append((*m.span(), names[m.group()]))
    return out


def replace(keyed: Keyed, text: str, memory: dict) -> tuple[str, list[tuple[str, str, str]]]:
    """The rewritten text and its (kind, canonical entity, canonical surrogate) mentions."""
    out, mentions, last = [], [], 0
    for s, e, kind in detect(text):
        surface = text[s:e]
        entity = canonical(kind, surface)
        group = "given" if kind.startswith("given") else kind
        new = memory.get((group, entity))
        if new is None:
            if len(memory) > 100_000:
                memory.clear()
            new = memory[group, entity] = surrogate(keyed, kind, entity)
        out += [text[last:s], render(kind, surface, new)]
        mentions.append((group, entity, new))
        last = e
    return "".join([*out, text[last:]]), mentions


REPLACED = "text string, mentions array<struct<kind:string,entity:string,surrogate:string>>"


def replaced_column(text: Column, secret: bytes, texts: bool = True) -> Column:
    """struct(text, mentions); the text is left out where only the mentions are wanted."""

    @F.pandas_udf(REPLACED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keyed, memory = Keyed(secret), {}
        for batch in batches:
            rows = [replace(keyed, t, memory) for t in batch]
            mentions = [[{"kind": k, "entity": e, "surrogate": n} for k, e, n in m] for _, m in rows]
            yield pd.DataFrame({"text": [t if texts else None for t, _ in rows], "mentions": mentions}, dtype=object)

    return run(F.coalesce(text, F.lit("")))


def collisions(mentions: DataFrame) -> DataFrame:
    """``kind, surrogate, n``: surrogates that stand for more than one entity, or an entity with more than one.

    Mentions are reduced to distinct triples first, so a name on a third of all rows is one row.
    """
    pairs = mentions.distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    torn = pairs.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.unionByName(torn.select("kind", F.col("entity").alias("surrogate"), "n"))


class Collision(ValueError):
    """Two entities share a surrogate, or one entity has two."""


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", check: bool = True) -> DataFrame:
    """Every row with personal data in ``text`` replaced, and ``n_entities`` added; other columns as they were.

    Kinds: e-mail, IPv4, bank card, social security number, IBAN, phone, given and family names (after a title or
    a known given name; given names are known in Latin, Cyrillic and Greek letters only, mailboxes and domains are
    found in letters of any script). Mentions of one entity get the same surrogate in all
    rows. A given or family name that was found so is replaced wherever it stands alone in the same text. With ``check`` all mentions of the corpus are compared before anything is returned.

    Null texts stay null with no entities; empty texts stay empty; repeated rows keep a row each; an empty table
    gives no rows; an existing column ``n_entities`` is replaced.
    """
    if check:
        found = docs.select(F.explode(replaced_column(F.col(text), secret, False)["mentions"]).alias("m")).select("m.*")
        bad = saved(collisions(found), "collisions").limit(5).collect()
        if bad:
            raise Collision(str(bad))
    both = docs.withColumn("_replaced", replaced_column(F.col(text), secret))
    names = [F.when(F.col(text).isNotNull(), F.col("_replaced.text")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "n_entities"]
    return both.select(*names, F.size("_replaced.mentions").cast("long").alias("n_entities"))
