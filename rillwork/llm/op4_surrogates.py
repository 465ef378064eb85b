"""Surrogates for personal data.

Entities (e-mail addresses, telephone, card, social security and account numbers, IP addresses, keys and passwords, dates of
birth, postal addresses, names) are replaced by keyed surrogates of the same type and format: digits for digits, letters of
the same script, case and kind (vowel or consonant) for letters, other signs as they are; card and account numbers keep
valid check digits, dates stay dates. Given names of the lists are replaced by names of the same gender, surnames of the
lists by surnames of the same list, and other names by names of syllables of their script, with the ending that tells the
gender where there is one.

Names are found by evidence: a title, a word of introduction or an honorific, or two or three capitalised words of which
one is a known given name or surname or has a surname's ending. A known given name alone is no evidence, as many are words
too. What is a name once is one everywhere in the text, and its surrogate depends on the name alone, whatever its title.

Numbers, addresses and keys go through a keyed permutation of the strings of their format: with pi a Feistel network over
the mixed radix number that the free characters spell, x becomes pi(pi^-1(x) + c). So it is never x itself, it needs no
table, one entity gets one surrogate everywhere (coreference), and two entities of one format never share one
(distinctness). Spellings of one entity (an address in other case, a number with other signs between) share their
surrogate's characters. Names of syllables are a keyed hash; the collision checks keep them apart.

Collision checks: the distinct entities of the corpus are gathered (hashes and values of entities only are shuffled,
after each task has made its own distinct) and every surrogate is compared with all others and with all entities, as it
must not name somebody else. Those that collide take the next permutation until no collision is left; from half of the
attempts on the formats of short entities widen, so that a full format can't hold the loop up, and if collisions are left
after the last attempt, an error says so. What remains is a table of the few exceptions, which tasks look up: broadcast if
it has at most BROADCAST_MAX rows, else joined by row.

Cases: a null text stays null. Texts of any length are searched whole, in time linear in their length. Rows with equal
or null ids are treated each. An empty table gives no rows. Other columns are passed through, whatever their names; where
one has the name of the entities' column, that is written with "_" behind it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise, read, row_keys, sliced

KEY = b"rillwork surrogate key"
ROUNDS = 6
ATTEMPTS = 32
BROADCAST_MAX = 50_000

#: Given names by gender; fixed values.
NAMES = {
    "f": "Alice Amelia Anna Barbara Camille Carmen Charlotte Chloe Claire Elena Elizabeth Emily Emma Eva Hannah Helena Ines Isabel Jennifer Jessica Julia Karen Laura Linda Lisa Lucia Maria Marie Mary Nancy Nora Olivia Patricia Rosa Sarah Sofia Sophie Susan Ursula Victoria".split(),
    "m": "Adam Alexander Andrew Anthony Antonio Bernd Carlos Charles Christopher Daniel David Edward Felix Francois George Hans Henry Hugo James Javier John Jose Joseph Juan Karl Klaus Louis Lucas Luis Mark Martin Matthew Michael Miguel Oscar Paul Peter Pierre Richard Robert Thomas William".split(),
}
GENDER = {n: g for g, names in NAMES.items() for n in names}
#: Surnames by where they are frequent; fixed values.
SURNAMES = {
    "english": "Smith Jones Taylor Brown Williams Wilson Johnson Davies Robinson Wright Thompson Evans Walker Roberts Hughes Edwards Miller Davis Moore Anderson Jackson Harris Clark Lewis Kelly Murphy Kennedy".split(),
    "german": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann".split(),
    "romance": "Dubois Durand Moreau Laurent Lefebvre Leroy Garcia García Martinez Lopez López Gonzalez Hernandez Fernandez Sanchez Perez Rodriguez Rossi Russo Ferrari Silva Santos Oliveira".split(),
    "slavic": "Ivanov Ivanova Petrov Petrova Novak Kowalski Nowak Horvat Kovač Kuznetsov Sokolov Popov".split(),
    "asian": "Wang Zhang Chen Liu Yang Huang Zhao Zhou Nguyen Tran Pham Kim Park Choi Tanaka Suzuki Sato Watanabe Yamamoto Sharma Singh Kumar Patel Gupta Khan Ali Hussain Ahmed".split(),
}
FAMILY = {n: g for g, names in SURNAMES.items() for n in names}
#: Given names that are also frequent words, places or brands; fixed values.
ALSO_WORDS = frozenset("Mark Rosa Victoria Charlotte Nancy Carmen Felix Oscar Nora Linda Helena Eva Hugo Ines Claire".split())
#: Endings of surnames; fixed values.
ENDINGS = re.compile(r"(?:\w{2}(?:ova|eva|enko|ovich|evich|ovic|ović|sky|ski|ska|skaya|wicz|czyk|escu|dottir|dóttir|sson|ssen|berg|stein|mann|poulos|idis|yan|ian|shvili|adze)|(?:Mc|Mac|O['’])[A-Z]\w+|\w{2}(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ский|ская|цкий|цкая|енко|чук))$")
#: Titles before names; fixed values.
TITLES = "Mr Mrs Ms Miss Mx Sir Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sra г-н г-жа господин госпожа".split()
#: What introduces a name; fixed values.
INTRODUCED = re.compile(r"(?i:(?<!\w)(?:my name is|name ?:|i am|i['’]m|named|dear|regards,|sincerely,|signed,?|je m['’]appelle|mein name ist|ich heiße|me llamo|mi nombre es|меня зовут))\s+")
#: Words that make capitalised ones no person; fixed values.
PLACES = frozenset("Street Road Avenue Lane Drive Station Park County City Town Airport University Hospital Island Islands Lake River Falls Beach Hall House Bridge Square School College Church Hotel Day Award Prize Museum Company Bank Group North South East West New Saint St The January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
#: Frequent first signs of Chinese names, and what follows a name in Chinese or Japanese; fixed values.
HAN_NAMES = "王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧程曹袁邓鄧许許傅沈曾彭吕呂"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红建文志国云海春辉晨雪"
HONORED = re.compile(rf"([{HAN_NAMES}][\u4e00-\u9fff]{{1,2}})(?=先生|女士|小姐|老师)|(?<=我叫)([{HAN_NAMES}][\u4e00-\u9fff]{{1,2}})|(?<=姓名[::])([{HAN_NAMES}][\u4e00-\u9fff]{{1,2}})|(?<![\u4e00-\u9fff])([\u4e00-\u9fff]{{2,4}})(?=さん|様)")

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.){1,8}[^\W\d_]{2,24}(?![\w-])")),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)(?:ghp|gho|ghs|xox[bap])[_-][0-9A-Za-z_-]{20,}+|(?<!\w)sk-[0-9A-Za-z_-]{20,}+|(?<!\w)(?=[0-9a-f]{0,63}\d)[0-9a-f]{32,64}(?!\w)")),
    ("secret", re.compile(r"(?i:(?<![^\W_])(?:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token))\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>,;]{6,}+)")),
    ("ip", re.compile(rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)|(?<![\w:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}})?::(?:[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{0,6}})?(?![\w:]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?![ -]?\d|\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{1,4}){2,5}(?!\w)")),
]
MONTHS = "January February March April May June July August September October November December".split()
BORN = re.compile(rf"(?i:(?<!\w)(?:born|birth ?date|date of birth|birthday|dob|d\.o\.b\.|geboren|geburtsdatum|née?|naissance|nacid[oa]|nacimiento|родил(?:ся|ась)|рождения))[^\d\n]{{0,20}}?(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{1,2}} (?:{'|'.join(MONTHS)}) \d{{4}}|(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}})(?!\d)", re.S)
BORN_MONTH = re.compile(rf"(?i:(?<!\w)(?:born|birthday)(?: on)? )((?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}})")
ADDRESS = [
    re.compile(r"(?<!\w)(\d{1,5} (?:[A-Z][a-z]+ ){1,2}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Terrace|Crescent))(?!\w)"),
    re.compile(r"(?<!\w)([A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?)(?!\w)"),
    re.compile(r"(?<!\w)(\d{1,4},? (?:rue|avenue|boulevard|place|chemin) (?:de la |du |de |des |d['’])?[A-ZÀ-Ý][\wà-ÿ-]+)"),
    re.compile(r"(?<!\w)((?:Calle|Avenida|Plaza|Paseo) (?:de (?:la )?|del )?[A-ZÀ-Ý][\wà-ÿ-]+,? \d{1,4})(?!\w)"),
]
ADDRESS_CUE = re.compile(r"\d (?:[A-Z]|rue|av|boul|pl|ch)|[a-zß] \d|, \d")
KEPT_WORDS = frozenset("Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Terrace Crescent Calle Avenida Plaza Paseo".split())
UPPER = r"A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮĶĹĻŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽΑ-ΩЀ-Я"
WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
NAME = rf"[{UPPER}](?:[^\W\d_]+|['’][{UPPER}][^\W\d_]+)(?:['’-][^\W\d_]+)*"
BETWEEN = r"(?:(?:de|da|del|di|van|von|der|den|bin|la|le) ){0,2}"
TITLED = re.compile(rf"(?<![\w-])(?:{'|'.join(map(re.escape, TITLES))})\.?[ \n]{BETWEEN}({NAME})(?: {BETWEEN}({NAME}))?(?: {BETWEEN}({NAME}))?")
RUN = re.compile(rf"(?<![\w'’-])({NAME})(?: [{UPPER}]\.)? {BETWEEN}({NAME})(?: {BETWEEN}({NAME}))?")
LONE = re.compile(rf"[“\"«„‘(]?(?<![\w'’-])({'|'.join(GENDER)})(?:-(?:{'|'.join(GENDER)}))?(?![\w-])")
NEXT = re.compile(rf"({NAME})(?: {BETWEEN}({NAME}))?(?: {BETWEEN}({NAME}))?")

Found = tuple[int, int, str, str]


def bare(word: str) -> str:
    """A name without the ending of a possessive."""
    return re.sub("['’]s$", "", word)


def name_parts(word: str, start: int) -> Iterator[tuple[int, str]]:
    """Where a word's parts between hyphens, and their pieces between apostrophes, begin."""
    for m in re.finditer("[^-]+", word):
        yield start + m.start(), bare(m[0])
        if bare(m[0]) != m[0] or "'" in m[0] or "’" in m[0]:
            yield from ((start + m.start() + x.start(), x[0]) for x in re.finditer("[^'’]+", m[0]))


def name_kind(word: str) -> str:
    """By the name alone: one of the given names, of the surnames, or another."""
    plain = name_value(word)
    return "given" if plain in GENDER else "family" if plain in FAMILY else "name"


def name_value(word: str) -> str:
    return word.capitalize() if word.isupper() and len(word) > 1 else word


def evident(words: list[str]) -> bool:
    """Whether one of two or three capitalised words shows that they are a person's name."""
    if any(w in PLACES for w in words) or len(set(words)) == 1:
        return False
    plain = [name_value(bare(w)) for w in words]
    return any(w in GENDER for w in plain[:-1]) or any(w in FAMILY or ENDINGS.search(w) for w in plain)


def names_in(text: str) -> Iterator[Found]:
    """Names that evidence shows, wherever they stand in the text."""
    kinds: set[str] = set()
    for m in TITLED.finditer(text):
        kinds.update(w for w in map(bare, filter(None, m.groups())) if w not in TITLES and w not in PLACES)
    for cue in INTRODUCED.finditer(text):
        m = NEXT.match(text, cue.end())
        if m and m[1] not in TITLES:
            words = [bare(w) for w in m.groups() if w]
            # One word after a word of introduction may begin a sentence; two are a name, or one that is known as such.
            if len(words) > 1 and not any(w in PLACES for w in words) or name_kind(words[0]) != "name":
                kinds.update(words)
    at = 0
    while m := RUN.search(text, at):
        words = [w for w in m.groups() if w]
        if words[0] in TITLES:
            at = m.end(1)
            continue
        if len(words) == 3 and name_kind(words[0]) == "name" and text[max(0, m.start() - 4) : m.start()].rstrip(" \"'(")[-1:] in ("", ".", "!", "?", "\n", ":") and evident(words[1:]):
            words = words[1:]  # the first word begins a sentence
        while len(words) > 1 and not evident(words):
            words = words[1:] if len(words) == 3 and evident(words[1:]) else words[:-1]
        if len(words) > 1:
            kinds.update(map(bare, words))
            at = m.end()
        else:
            at = m.end(1)
    for m in LONE.finditer(text):
        quoted, hyphen = m[0][0] in "“\"«„‘(", "-" in m[0]
        begins = text[max(0, m.start() - 4) : m.start()].rstrip(" ")[-1:] in ("", ".", "!", "?", "\n", ":")
        if m[1] not in ALSO_WORDS and (quoted or hyphen or not begins):
            kinds.update(re.findall(r"\w+", m[0]))
    kinds = {name_value(w) for w in kinds}
    if kinds:
        for m in re.finditer(WORD, text):
            if name_value(m[0]) in kinds:
                yield m.start(), m.end(), name_kind(m[0]), name_value(m[0])
            elif "-" in m[0] or "'" in m[0] or "’" in m[0]:
                end = 0
                for s, part in ((m.start(), bare(m[0])), *name_parts(m[0], m.start())):
                    if name_value(part) in kinds and s >= end:
                        yield s, (end := s + len(part)), name_kind(part), name_value(part)


def han_names_in(text: str) -> Iterator[Found]:
    for m in HONORED.finditer(text):
        yield (*m.span(m.lastindex), "name", m[m.lastindex])


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    own = [int(c) for c in reversed(digits)]
    return -(sum(sum(divmod(2 * x, 10)) for x in own[::2]) + sum(own[1::2])) % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def canonical(kind: str, value: str) -> str:
    """What spellings of one entity share."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":
        return ("+" if value[0] == "+" else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value


def compressed(value: str) -> bool:
    """Whether value is an IPv6 address with left out groups, other than all of them."""
    return len(value) > 2 and sum(map(bool, value.split(":"))) < 8


def entities(text: str) -> list[Found]:
    """start, end, kind and canonical value of the entities, in order; of overlapping ones the first, of those the longest."""
    found: list[Found] = []
    if any(c.isdigit() for c in set(text)) or "@" in text or "=" in text or ":" in text:
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                s, e = m.span(m.lastindex or 0)
                if "::" in text[s:e] and kind == "ip" and not compressed(text[s:e]):
                    continue
                if kind == "iban" and text[s + 2 : s + 4] != iban_check(text[s : s + 2], re.sub(" ", "", text[s + 4 : e])):
                    continue
                found.append((s, e, kind, canonical(kind, text[s:e])))
        for pattern in (BORN, BORN_MONTH):
            found += [(*m.span(1), "date", m[1]) for m in pattern.finditer(text) if date_of(m[1])]
        if ADDRESS_CUE.search(text):
            found += [(*m.span(1), "address", m[1]) for pattern in ADDRESS for m in pattern.finditer(text)]
    found += names_in(text)
    if "先" in text or "女" in text or "小" in text or "老" in text or "叫" in text or "名" in text or "さん" in text or "様" in text:
        found += han_names_in(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[Found] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def date_of(value: str) -> tuple[datetime.date, str] | None:
    """A date and its format."""
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%d %B %Y", "%B %d, %Y"):
        try:
            return datetime.datetime.strptime(value, form).date(), form
        except ValueError:
            pass
    return None


#: Syllables by script and endings that tell the gender; fixed values.
SYLLABLES = {
    "latin": ("b c d f g h j k l m n p r s t v w br dr gr kr st tr".split(), "a e i o u".split(), ["", "n", "l", "r", "s"]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ст гр кр".split(), "а е и о у".split(), ["", "н", "л", "р", "с"]),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο".split(), ["", "ν", "ρ", "λ"]),
}
GENDERED = re.compile("(?:ova|eva|skaya|ska|ская|цкая|ский|цкий|ова|ева|ёва|ина|енко|ов|ев|ёв|ин|a|а|α|á)$")


def script_of(word: str) -> str:
    c = word[0]
    return "latin" if c < "Ͱ" else "greek" if c < "Ѐ" else "cyrillic" if c < "\u0530" else "han" if "\u4e00" <= c <= "\u9fff" else ""


def made_name(key: bytes, tweak: str, word: str, more: bool) -> str:
    """A name of syllables by a keyed hash of word; its parts between hyphens each."""
    script = script_of(word)
    n = int.from_bytes(hmac.digest(key, f"{tweak}|{word}".encode("utf-8", "surrogatepass"), hashlib.sha512), "big")
    if script == "han":
        n, i = divmod(n, len(HAN_NAMES))
        out = HAN_NAMES[i]
        for _ in range(max(1, len(word) - 1) + more):
            n, i = divmod(n, len(HAN_GIVEN))
            out += HAN_GIVEN[i]
        return out
    if not script:
        return permuted(key, tweak, word)
    heads, vowels, tails = SYLLABLES[script]
    kept = GENDERED.search(word.lower()) if len(word) > 3 else None
    out = ""
    for k in range(3 + more):
        n, i = divmod(n, len(heads))
        n, j = divmod(n, len(vowels))
        n, t = divmod(n, len(tails))
        out += heads[i] + ("" if kept and k == 2 + more else vowels[j] + tails[t])
    out += kept[0] if kept else ""
    out = out.capitalize()
    return out.upper() if word.isupper() and len(word) > 1 else out


#: Letters of scripts whose block also has letters that are out of use; fixed values.
MODERN = [("Α", "Ω"), ("α", "ω"), ("А", "Я"), ("а", "я"), ("À", "Þ"), ("ß", "ÿ"), ("あ", "ん"), ("ア", "ン")]


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that may stand for c: digits; ASCII vowels or consonants of its case; else the letters of its block and category."""
    if c.isascii():
        if c.isdigit():
            return "0123456789"
        if c.isalpha():
            own = "aeiou" if c in "aeiouAEIOU" else "bcdfghjklmnpqrstvwxyz"
            return own.upper() if c.isupper() else own
        return ""
    category, block = unicodedata.category(c), ord(c) // 128 * 128
    if category[0] not in "LN":
        return ""
    modern = next((x for x in MODERN if x[0] <= c <= x[1]), None)
    if modern:
        return "".join(chr(x) for x in range(ord(modern[0]), ord(modern[1]) + 1) if unicodedata.category(chr(x)) == category)
    return "".join(chr(x) for x in range(block, block + 128) if unicodedata.category(chr(x)) == category)


class Permutation:
    """A keyed permutation without fixed points of the strings that share the alphabets' radices."""

    def __init__(self, key: bytes, tweak: str, radices: tuple[int, ...]) -> None:
        self.radices, self.key, self.tweak = radices, key, tweak.encode()
        self.size = [1, 1]
        for i, r in enumerate(radices):
            self.size[i % 2] *= r

    def _round(self, k: int, x: int) -> int:
        return int.from_bytes(hmac.digest(self.key, b"%d|%b|%x" % (k, self.tweak, x), hashlib.sha512), "big") * 0x1_0000_0001_0000_0001 >> 7

    def _split(self, digits: list[int]) -> list[int]:
        halves = [0, 0]
        for i, (d, r) in enumerate(zip(digits, self.radices)):
            halves[i % 2] = halves[i % 2] * r + d
        return halves

    def _join(self, halves: list[int]) -> list[int]:
        out = [0] * len(self.radices)
        for i in range(len(out) - 1, -1, -1):
            halves[i % 2], out[i] = divmod(halves[i % 2], self.radices[i])
        return out

    def _turn(self, halves: list[int], back: bool) -> None:
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            own, other = k % 2, 1 - k % 2
            step = self._round(k, halves[other])
            halves[own] = (halves[own] + (-step if back else step)) % self.size[own]

    def __call__(self, digits: list[int]) -> list[int]:
        total = self.size[0] * self.size[1]
        if total < 2:
            return digits
        halves = self._split(digits)
        self._turn(halves, True)
        number = (halves[0] * self.size[1] + halves[1] + 1 + self._round(ROUNDS, 0) % (total - 1)) % total
        halves = list(divmod(number, self.size[1]))
        self._turn(halves, False)
        return self._join(halves)


def permuted(key: bytes, tweak: str, text: str, alphabets: list[str] | None = None) -> str:
    own = alphabets or [alphabet(c) if c in alphabet(c) else "" for c in text]
    free = [i for i, a in enumerate(own) if a]
    shape = "".join(own[i][0] if own[i] else c for i, c in enumerate(text))
    digits = Permutation(key, f"{tweak}|{shape}", tuple(len(own[i]) for i in free))([own[i].index(text[i]) for i in free])
    out = list(text)
    for i, d in zip(free, digits):
        out[i] = own[i][d]
    return "".join(out)


HEX = "0123456789abcdef"
#: Characters of a secret beyond which it is permuted in pieces, so that time stays linear and a round's hash covers half a piece.
LONG = 256
PIECE = 128


def long_permuted(key: bytes, tweak: str, text: str) -> str:
    """Piece by piece, each under a permutation that the pieces before it choose: still one to one, as they can be taken back in turn."""
    own = HEX if re.fullmatch("[0-9a-f]+", text) else None
    before, out = hashlib.sha256(), []
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        out.append(permuted(key, f"{tweak}|{len(text)}|{before.hexdigest()}", piece, [own] * len(piece) if own else None))
        before.update(piece.encode("utf-8", "surrogatepass"))
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """Of a canonical value, in canonical spelling."""
    tweak = f"{kind}|{attempt}"
    wide = attempt >= ATTEMPTS // 2
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        more = permuted(key, f"{tweak}|{value}", "000") if wide else ""
        return permuted(key, tweak, local) + more + "@" + ".".join([*(permuted(key, f"domain|{attempt}", x) for x in labels[:-1]), labels[-1]])
    if kind == "date":
        day, form = date_of(value)
        low = datetime.date(1930, 1, 1)
        span = (datetime.date(2010, 1, 1) - low).days
        # Days before or after the span take the days of another one of its length.
        era, at = divmod((day - low).days, span)
        new = low + datetime.timedelta(days=era * span + Permutation(key, f"date|{era}", (span,))([at])[0])
        made = new.strftime(form)
        return made if re.search(r"(?<!\d)0\d", value) or form == "%Y-%m-%d" else re.sub(r"(?<!\d)0(\d)(?!\d*:)", r"\1", made)
    if kind == "address":
        parts = re.findall(r"\d+|[^\W\d_]+|.", value, re.S)
        out = []
        for x in parts:
            if x.isdigit():
                out.append(permuted(key, f"{tweak}|{value}", x).lstrip("0") or "7")
            elif x[0].isupper() and x not in KEPT_WORDS:
                tail = next((t for t in ("straße", "strasse", "weg", "platz", "allee", "gasse") if x.endswith(t)), "")
                out.append(made_name(key, tweak, x.removesuffix(tail) or x, wide) + tail)
            else:
                out.append(x)
        return "".join(out)
    if kind == "card":
        if luhn(value[:-1]) == int(value[-1]):
            body = value[0] + permuted(key, f"{tweak}|luhn", value[1:-1])
            return body + str(luhn(body))
        # Not a valid number: a permutation of invalid ones, by the digits before the last and the last's distance from the valid one.
        body = value[0] + permuted(key, f"{tweak}|other", value[1:-1])
        return body + str((luhn(body) + int(value[-1]) - luhn(value[:-1])) % 10)
    if kind == "iban":
        rest = permuted(key, f"{tweak}|{value[:2]}", value[4:])
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "ip":
        if ":" in value:
            return permuted(key, tweak, value, [HEX if c in HEX else HEX.upper() if c in HEX.upper() else "" for c in value])
        own = [int(x) for x in value.split(".")]
        if wide:
            return ".".join(map(str, Permutation(key, f"{tweak}|wide", (256,) * 4)(own)))
        low = [0 if x < 10 else 10 if x < 100 else 100 for x in own]
        sizes = [{0: 10, 10: 90, 100: 156}[x] for x in low]
        turned = Permutation(key, f"{tweak}|{sizes}", tuple(sizes))([x - b for x, b in zip(own, low)])
        return ".".join(str(x + b) for x, b in zip(turned, low))
    if kind == "phone":
        # The country code, which no rule cuts off without a table, keeps its first digit.
        head = value[:2] if value[0] == "+" else ""
        return head + permuted(key, tweak, value[len(head) :])
    if kind == "secret":
        head = value[:4] if value[:4] in ("AKIA", "ASIA", "ghp_", "gho_", "ghs_") else ""
        rest = value[len(head) :]
        if len(rest) > LONG:
            return head + long_permuted(key, tweak, rest)
        return head + permuted(key, tweak, rest, [HEX] * len(rest) if re.fullmatch("[0-9a-f]{12,}", rest) else None)
    if kind in ("given", "family"):
        names = NAMES[GENDER[value]] if kind == "given" else SURNAMES[FAMILY[value]]
        return names[Permutation(key, tweak, (len(names),))([names.index(value)])[0]]
    if kind == "name":
        return "-".join(made_name(key, tweak, x, wide) for x in value.split("-") if x)
    return permuted(key, tweak, value)


def spelled(kind: str, original: str, new: str) -> str:
    """new in the original's spelling: its case, or its signs between the characters."""
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) if len(original) == len(new) else new
    if kind in ("card", "ssn", "phone", "iban"):
        own = iter(new.lstrip("+"))
        return "".join(next(own) if c.isalnum() else c for c in original)
    return new.upper() if kind in ("given", "family", "name") and original.isupper() and len(original) > 1 else new


def kind_group(kind: str) -> str:
    """Kinds whose surrogates are compared with each other."""
    return "name" if kind in ("given", "family") else kind


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        found = list({x[2:] for t in b.column("text").to_pylist() if t for x in entities(t)})
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], names=["kind", "value"])


def _surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("kind", "value", "attempt"))))
            made = [surrogate(key, *r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array([kind_group(r[0]) for r in rows], pa.string()), b.column("value"), b.column("attempt"), pa.array(made, pa.string())], names=["kind", "grp", "value", "attempt", "made"])

    return run


def exceptions(docs: DataFrame, text_col: str = "text", key: bytes = KEY, attempts: int = ATTEMPTS) -> DataFrame:
    """kind, value, attempt of the entities whose first surrogate collides with another's or with an entity, attempt being the first permutation after it without collision."""
    known = materialise(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_entities, "kind string, value string").distinct())
    schema = "kind string, grp string, value string, attempt int, made string"
    now = materialise(known.withColumn("attempt", F.lit(0)).mapInArrow(_surrogates(key), schema))
    real = now.select("grp", F.col("value").alias("made")).distinct()
    for _ in range(attempts):
        # A name of the lists takes another by design, and a date names nobody, so only their distinctness counts.
        twice = now.groupBy("grp", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value", "kind")).alias("first")).filter("n > 1")
        second = now.join(twice, ["grp", "made"]).filter(F.struct("attempt", "value", "kind") > F.col("first")).select("kind", "value")
        taken = now.filter(~F.col("kind").isin("given", "family", "date")).join(real, ["grp", "made"], "left_semi").select("kind", "value")
        losers = materialise(second.union(taken).distinct())
        if losers.isEmpty():
            break
        moved = now.join(losers, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_surrogates(key), schema)
        now = materialise(now.join(losers, ["kind", "value"], "left_anti").unionByName(moved))
    else:
        raise RuntimeError(f"surrogates still collide after {attempts} attempts: the formats are too narrow for this corpus")
    return now.filter("attempt > 0").select("kind", "value", "attempt")


def replaced(text: str, key: bytes, attempt_of: dict[tuple[str, str], int], cache: dict) -> tuple[str, list[dict]]:
    out, spans, at = [], [], 0
    for s, e, kind, value in entities(text):
        if (kind, value) not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[kind, value] = surrogate(key, kind, value, attempt_of.get((kind, value), 0))
        new = spelled(kind, text[s:e], cache[kind, value])
        out += [text[at:s], new]
        at = e
        spans.append({"kind": kind, "start": s, "end": e, "surrogate": new})
    return "".join([*out, text[at:]]), spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def _replace(key: bytes, table, text_name: str, attempts_name: str, entities_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in sliced(batches):
            texts, spans = [], []
            own = b.column(attempts_name).to_pylist()
            for t, mine in zip(b.column(text_name).to_pylist(), own):
                if mine:
                    t, found = replaced(t, key, {(x["kind"], x["value"]): x["attempt"] for x in mine}, {})
                elif t is not None:
                    t, found = replaced(t, key, table.value if table else {}, cache)
                else:
                    found = []
                texts.append(t)
                spans.append(found)
            b = b.drop_columns([attempts_name])
            b = b.set_column(b.schema.get_field_index(text_name), pa.field(text_name, pa.string()), pa.array(texts, pa.string()))
            yield b.append_column(entities_name, pa.array(spans, SPANS))

    return run


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        rows = [(k1, k2, *x) for k1, k2, t in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text"))) if t for x in {y[2:] for y in entities(t)}]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["k1", "k2", "kind", "value"])


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, broadcast_max: int = BROADCAST_MAX, entities_col: str = "entities") -> DataFrame:
    """The documents with all their columns, text_col with surrogates, and entities_col: kind, start and end in the old text, surrogate."""
    odd = materialise(exceptions(docs, text_col, key))
    names = docs.columns
    text_name, attempts_name, entities_name = (free_name(names, x) for x in ("text__", "attempts__", "entities__"))
    attempts = "array<struct<kind:string,value:string,attempt:int>>"
    columns = [F.col(f"`{c}`").cast("string").alias(text_name) if c == text_col else F.col(f"`{c}`") for c in names]
    if odd.count() > broadcast_max:
        found = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(_of_rows, "k1 long, k2 long, kind string, value string")
        own = found.join(odd, ["kind", "value"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("own"))
        rows = docs.select(*row_keys(id_col, text_col), F.struct(*columns).alias("row"))
        given = rows.join(own, ["k1", "k2"], "left").select("row.*", F.col("own").cast(attempts).alias(attempts_name))
        table = None
    else:
        given = docs.select(*columns, F.lit(None).cast(attempts).alias(attempts_name))
        table = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in odd.collect()})
    spans = F.lit(None).cast("array<struct<kind:string,start:int,end:int,surrogate:string>>").alias(entities_name)
    schema = given.drop(attempts_name).select("*", spans).schema
    made = given.mapInArrow(_replace(key, table, text_name, attempts_name, entities_name), schema)
    out = [F.col(text_name).alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return made.select(*out, F.col(entities_name).alias(free_name(names, entities_col)))


def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (with surrogates), n_entities."""
    made = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"))
