"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Detected: e-mail addresses (whole local parts, of any length and any European script), telephone numbers, card and account
numbers (13 to 19 digits), social security numbers, IBANs with a valid checksum, IP addresses (v4, and v6 in full and
compressed form), MAC addresses and names of persons. A name is found by a cue: a known given name or a title before a
capitalised word, words that stand before a person (``CUES``) before two of them, or a list that a person began ("met Ann Lee and Priya
Sharma"); then also each of these words alone in the same text. There is no statistical tagger, so names without such a cue
and names in scripts without capitals stay.

Surrogate: an entity's canonical form (a telephone number's digits, a lower-case address ...) is a number in the domain of
all forms of the same shape. A keyed permutation of that domain (a Feistel network with cycle walking, conjugated with a
shift so that nothing maps to itself) gives the surrogate, which is written in the format of the mention. So

* type and format hold: digits stay digits, vowels vowels, accents and scripts stay, checksums stay valid (or
  invalid), private addresses private, fictional exchanges (555) and example domains as they are, letter case as it was;
* gender and script hold: a known given name becomes another of its gender and script, an unknown one after a title of a
  gender two names of that gender joined by a hyphen; a frequent family name becomes another of its script;
* coreference holds: mentions in other formats or documents share the canonical form, hence the surrogate; a person's
  given and family names are mapped each for itself, so parts of a name stay consistent;
* distinctness holds: a permutation has no collisions.

Collision checks: over the table of the corpus's distinct entities, a surrogate that equals somebody's real value is drawn
anew (a permutation of the next attempt), and so is every surrogate that then equals another; rounds go on until nothing
collides. Domains under ``SMALL`` and, after ``ROUNDS`` rounds, dense ones can't avoid real values: they keep distinctness
alone. A shape whose surrogates still collide after ``LAST`` rounds returns to the first attempt (joined names: to letter by
letter permutation), which is free of collisions by construction.

The key comes from the caller or from ``spark.vellumine.pii.key``. Without either a random one is drawn for the driver's
process, so nobody can turn surrogates back, and another process gives others.

Entities with a later attempt are exceptions. Up to ``MAX_EXCEPTIONS`` of them are broadcast; more are joined to the rows
that mention them (salted, since a third of all rows may mention one).

Defined cases: null texts stay null and empty ones empty; repeated rows and ids are treated row by row; null ids pass
through; an empty table gives an empty result; all other columns are kept and new names never clash.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import column, fresh, prepare, shared_dir, table, written

SMALL = 10_000
ROUNDS = 8
LAST = 24
PIECE = 200  # characters that are permuted as one number
LETTERS = -1  # the attempt that permutes letter by letter
MAX_EXCEPTIONS = 50_000
SALTS = 16

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa
        Deborah Laura Emma Olivia Anna Maria Julia Claire Camille Sophie Marie Isabelle Carmen Lucia Elena Sofia Ursula Heike Sabine Ingrid Petra Heather Priya Fatima Aisha Mei Yuki""".split(),
    ("latin", "m"): """James Robert John Michael David William Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kevin Brian
        George Edward Peter Pierre Jean Louis Antoine Carlos Miguel Javier Diego Pablo José Hans Klaus Stefan Wolfgang Jürgen Mohammed Ahmed Ali Raj Arjun Wei Hiroshi Kenji""".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Людмила".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Андрей Николай Владимир Павел Михаил Александр".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Βασίλης".split(),
}
# Frequent family names by script.
FAMILY = {
    "latin": """Smith Johnson Williams Brown Jones Miller Davis Garcia Rodriguez Martinez Hernandez Lopez Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis
        Walker Hall Young King Wright Scott Green Baker Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Dubois Durand Moreau Laurent Rossi Ferrari Sharma Patel Singh Khan Chen Wang""".split(),
    "cyrillic": "Иванов Петров Сидоров Смирнов Кузнецов Попов Волков Соколов Иванова Петрова Смирнова Кузнецова".split(),
    "greek": "Παπαδόπουλος Οικονόμου Γεωργίου Δημητρίου Νικολάου Παππάς".split(),
}
# Titles that stand before a name, by the gender they tell.
GENDERED = {"f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Господин Κύριος".split(), "": "Dr Prof".split()}
# Words that stand before the name of a person.
CUES = "my name is,i am,dear,met,told,asked,thanked,married,interviewed,emailed,phoned,attn,signed,yours sincerely,kind regards,best regards".split(",")

TITLES = {t: g for g, titles in GENDERED.items() for t in titles}
_NAMES = {name.lower(): (f"given:{s}:{g}", i) for (s, g), names in GIVEN.items() for i, name in enumerate(names)}
_LISTS = {f"given:{s}:{g}": [n.lower() for n in names] for (s, g), names in GIVEN.items()} | {f"family:{s}": [n.lower() for n in names] for s, names in FAMILY.items()}
_FAMILIES = {name.lower(): f"family:{s}" for s, names in FAMILY.items() for name in names}
# Alphabets: a letter is replaced by one of its own.
_GROUPS = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "áéíóúàèìòùâêîôûäëïöüãõåæøœ", "çñßšžčćłńśźżřďťý", "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ")
_ALPHABET = {c: g for g in _GROUPS for c in g}
_LETTERS = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: _GROUPS[0] for c in _GROUPS[0]}
_MAIL = {c: g for c, g in _ALPHABET.items() if c > "z"} | _LETTERS
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}

_START = re.compile(r"(?<![0-9])[+(]?[0-9]")
_NUMBER = re.compile(
    r"""(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<phone>(?<!\w)\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])
        |(?<!\w)\([0-9]{3}\)\ ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.+-])(?:1[ .-])?[0-9]{3}(?P<a>[-. ])[0-9]{3}(?P=a)[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?P<b>[ -])[0-9]{4}(?P=b)[0-9]{4}(?P=b)[0-9]{1,7}|[0-9]{4}(?P<c>[ -])[0-9]{6}(?P=c)[0-9]{5})(?![\w-]))""",
    re.X,
)
_EURO = "\u00c0-\u024f\u0370-\u058f"  # letters of European scripts beyond ASCII
_NOT_LOCAL = re.compile(rf"[^A-Za-z0-9._%+\-{_EURO}]")
_DOMAIN = re.compile(rf"(?:[A-Za-z0-9{_EURO}](?:[A-Za-z0-9{_EURO}-]*[A-Za-z0-9{_EURO}])?\.)+[A-Za-z{_EURO}]{{2,}}")
_HEXED = re.compile(r"(?<![\w:.])(?:(?P<mac>(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2})(?![\w:])|(?P<ip6>(?:[0-9A-Fa-f]{1,4}|(?=::))(?::[0-9A-Fa-f]{0,4}){2,7}(?<!:))(?![\w:]))")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CAPITALS = "A-ZÀ-ÖØ-ÞА-ЯЁΆ-ΏΑ-Ω"
_WORD = rf"[{_CAPITALS}][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_PERSON = re.compile(rf"(?<![\w@.])({_WORD})\.? ({_WORD})(?: ({_WORD}))?")

Found = tuple[int, int, str, str]  # start, end, type, canonical form


def _luhn(digits: str) -> int:
    """The digit that makes ``digits`` valid when appended."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _phone(s: str) -> str:
    """A number's digits; North American numbers without the country's 1, others with a + if written."""
    d = _digits(s)
    if len(d) == 11 and d[0] == "1":
        return d[1:]
    return d if len(d) == 10 and s[0] != "+" else ("+" if s[0] == "+" else "") + d


_CUE = re.compile(rf"(?<!\w)(?i:{'|'.join(CUES)})[:,]?\s+({_WORD}) ({_WORD})")
_NEXT = re.compile(rf"(?:,? (?:and|und|et|y|и|και)|,) ({_WORD}) ({_WORD})(?![\w@])")


def _script(name: str) -> str:
    return "greek" if "\u0370" <= name[0] < "\u0400" else "cyrillic" if "\u0400" <= name[0] < "\u0530" else "latin"


def _kind(name: str, given: bool, gender: str = "") -> str:
    """The type of a part of a name."""
    if name in _NAMES:
        return _NAMES[name][0]
    if given and gender:
        return f"unlisted:{_script(name)}:{gender}"
    return _FAMILIES.get(name, "family")


def _persons(text: str) -> list[Found]:
    out, parts = [], {}

    def add(m: re.Match, g: int, given: bool = False, gender: str = "") -> int:
        name = m[g].lower()
        kind = _kind(name, given, gender)
        out.append((m.start(g), m.end(g), kind, name))
        parts[m[g]] = parts[m[g].upper()] = (kind, name)
        return m.end(g)

    def listed(at: int) -> int:
        """The persons that a list goes on with."""
        while (m := _NEXT.match(text, at)) and m[1] not in TITLES:
            add(m, 1)
            at = add(m, 2)
        return at

    at = 0
    while m := _PERSON.search(text, at):
        first, end = m[1], m.end(1)
        if first in TITLES:
            groups = [g for g in (2, 3) if m[g] and m[g] not in TITLES]
            for g in groups:
                end = add(m, g, len(groups) == 2 and g == 2, TITLES[first])
        elif first.lower() in _NAMES:
            for g in (1, 2, 3) if m[3] and m[2].lower() in _NAMES else (1, 2):
                end = add(m, g)
        at = listed(end) if end > m.end(1) else end
    for m in _CUE.finditer(text):
        if m[1] not in TITLES:
            add(m, 1)
            listed(add(m, 2))
    if parts:
        alone = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, parts), key=lambda x: (-len(x), x))) + r")(?!\w)")
        out += [(m.start(), m.end(), *parts[m[0]]) for m in alone.finditer(text)]
    return out


def _ip6(s: str) -> str | None:
    """The full form of an address in any form; other runs of colons and hex digits, as in times and code, are none."""
    if "::" in s and (sum(map(bool, s.split(":"))) < 2 or not any(c.isdigit() for c in s)):
        return None
    try:
        return ipaddress.IPv6Address(s).exploded
    except ValueError:
        return None


def _local_start(text: str, least: int, at: int) -> int:
    """Where the local part that ends at ``at`` begins; no further back than ``least``."""
    start = at
    while start > least and not _NOT_LOCAL.match(text, start - 1):
        start -= 1
    while start < at and text[start] in ".%+-_":
        start += 1
    return start


def find(text: str) -> list[Found]:
    """The entities of a whole text, in order and without overlap (the earliest, then the longest, wins)."""
    out: list[Found] = []
    at, before = text.find("@"), 0
    while at >= 0:
        if right := _DOMAIN.match(text, at + 1):
            start = _local_start(text, before, at)
            if start < at and text[at - 1] != ".":
                out.append((start, right.end(), "email", text[start : right.end()].lower()))
        before, at = at + 1, text.find("@", at + 1)
    at, m = 0, _START.search(text)
    while m:
        n = _NUMBER.match(text, m.start()) or _NUMBER.match(text, m.end() - 1)
        at = m.end()
        if n:
            kind, s = n.lastgroup, n[0]
            if kind == "ip":
                octets = [int(x) for x in s.split(".")]
                if max(octets) < 256:
                    out.append((n.start(), n.end(), "ip", ".".join(map(str, octets))))
                    at = n.end()
            elif kind == "phone":
                if 8 <= len(_digits(s)) <= 15:
                    out.append((n.start(), n.end(), "phone", _phone(s)))
                    at = n.end()
            else:
                out.append((n.start(), n.end(), kind, _digits(s)))
                at = n.end()
        m = _START.search(text, at)
    if ":" in text:
        for n in _HEXED.finditer(text):
            canon = n[0].lower() if n.lastgroup == "mac" else _ip6(n[0])
            if canon:
                out.append((n.start(), n.end(), n.lastgroup, canon))
    for n in _IBAN.finditer(text):
        s = n[0].replace(" ", "")
        if 15 <= len(s) <= 34 and _mod97(s) == 1:
            out.append((n.start(), n.end(), "iban", s))
    out += _persons(text)
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], 0
    for f in out:
        if f[0] >= end:
            kept.append(f)
            end = f[1]
    return kept


class Cipher:
    """Keyed permutations of the numbers from 0 up to n."""

    def __init__(self, key: str, label: str, n: int) -> None:
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.low = (1 << self.half) - 1
        self.seed = hashlib.blake2b(f"{label}\0{n}".encode(), key=hashlib.sha256(key.encode()).digest()).digest()

    def _f(self, k: int, x: int) -> int:
        raw = x.to_bytes(self.half // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(raw, key=self.seed[:63] + bytes([k]), digest_size=min(64, self.half // 8 + 2)).digest(), "big") & self.low

    def _once(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & self.low
        for k in reversed(range(8)) if back else range(8):
            a, b = (b ^ self._f(k, a), a) if back else (b, a ^ self._f(k, b))
        return a << self.half | b

    def apply(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def moved(self, x: int) -> int:
        """A permutation without fixed points (for n over 1)."""
        return self.apply((self.apply(x) + 1) % self.n, back=True)


@lru_cache(4096)
def _cipher(key: str, label: str, n: int) -> Cipher:
    return Cipher(key, label, n)


def _permuted(s: str, alphabets: dict[str, str], key: str, label: str, fixed: range | tuple = ()) -> tuple[str, int]:
    """``s`` with each character moved within its alphabet, and the size of the domain; long forms piece by piece."""
    if len(s) > PIECE:
        parts = [_permuted(s[i : i + PIECE], alphabets, key, f"{label}:{i}") for i in range(0, len(s), PIECE)]
        return "".join(p for p, _ in parts), max(n for _, n in parts)
    places = [(i, alphabets[c]) for i, c in enumerate(s) if c in alphabets and i not in fixed]
    n, x = 1, 0
    for i, a in places:
        n, x = n * len(a), x * len(a) + a.index(s[i])
    if n == 1:
        return s, 1
    shape = "".join(alphabets[c][0] if c in alphabets and i not in fixed else c for i, c in enumerate(s))
    x = _cipher(key, f"{label}:{shape}", n).moved(x)
    out = list(s)
    for i, a in reversed(places):
        x, r = divmod(x, len(a))
        out[i] = a[r]
    return "".join(out), n


def _reserved(domain: str) -> bool:
    """Domains that name nobody."""
    return domain.split(".")[-1] in ("test", "example", "invalid", "localhost") or ".".join(domain.split(".")[-2:]) in ("example.com", "example.net", "example.org")


def _ip_kind(s: str) -> str:
    a = ipaddress.ip_address(s)
    return next((str(n) for n in _PRIVATE if a in n), "public")


_PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]


@lru_cache(1 << 16)
def surrogate(kind: str, canon: str, attempt: int, key: str) -> tuple[str, int]:
    """The surrogate's canonical form, and the size of the domain it is drawn from."""
    label = f"{kind}:{attempt}"
    if kind in _LISTS:
        names = _LISTS[kind]
        return names[_cipher(key, label, len(names)).moved(names.index(canon))], len(names)
    if kind == "family" or attempt == LETTERS:
        return _permuted(canon, _ALPHABET, key, label)
    if kind.startswith("unlisted:"):
        names = _LISTS[kind.replace("unlisted", "given")]
        n = len(names) * (len(names) - 1)
        i, j = divmod(int.from_bytes(hashlib.blake2b(f"{label}\0{canon}".encode(), key=hashlib.sha256(key.encode()).digest()).digest(), "big") % n, len(names) - 1)
        return f"{names[i]}-{names[j + (j >= i)]}", n
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        new, n = _permuted(local, _MAIL, key, f"{label}@{domain}")
        if not _reserved(domain):
            name, _, top = domain.rpartition(".")
            moved, k = _permuted(name, _MAIL, key, "domain")  # alike in all attempts: one domain, one surrogate
            domain, n = f"{moved}.{top}", n * k
        return f"{new}@{domain}", n
    if kind == "phone":
        plus = 3 if canon[0] == "+" else 0  # the country stays
        return _permuted(canon, _LETTERS, key, label, (3, 4, 5) if len(canon) == 10 and canon[3:6] == "555" else range(plus))
    if kind == "card":
        off = (int(canon[-1]) - _luhn(canon[:-1])) % 10  # 0: valid, and so is the surrogate
        body, n = _permuted(canon[:-1], _LETTERS, key, f"{label}:{off}", (0,))
        return body + str((_luhn(body) + off) % 10), n
    if kind == "iban":
        alphabets = _LETTERS | {c.upper(): a.upper() for c, a in _LETTERS.items() if c.isalpha()}
        body, n = _permuted(canon[4:], alphabets, key, f"{label}:{canon[:2]}")
        return f"{canon[:2]}{98 - _mod97(canon[:2] + '00' + body):02d}{body}", n
    if kind == "ip6":  # the first group (which tells private from public), groups of zeros and the prefix of examples stay
        groups = canon.split(":")
        places = [i for i, g in enumerate(groups) if i and g != "0000" and (i, groups[0], g) != (1, "2001", "0db8")]
        n, x = 0xFFFF ** len(places), 0
        for i in places:
            x = x * 0xFFFF + int(groups[i], 16) - 1
        shape = ":".join("x" if i in places else g for i, g in enumerate(groups))
        x = _cipher(key, f"{label}:{shape}", n).moved(x) if n > 1 else x
        for i in reversed(places):
            x, r = divmod(x, 0xFFFF)
            groups[i] = f"{r + 1:04x}"
        return ":".join(groups), n
    if kind == "ip":
        known = _ip_kind(canon)
        net = ipaddress.ip_network(known if known != "public" else "0.0.0.0/0")
        n, base = net.num_addresses, int(net.network_address)
        x = int(ipaddress.ip_address(canon)) - base
        while True:
            x = _cipher(key, f"{label}:{known}", n).moved(x)
            new = str(ipaddress.IPv4Address(base + x))
            if known != "public" or _ip_kind(new) == "public":
                return new, n
    return _permuted(canon, _HEX if kind == "mac" else _LETTERS, key, label)


def render(mention: str, kind: str, new: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("phone", "card", "ssn"):
        d = _digits(new)
        own = sum(c in "0123456789" for c in mention)
        d = mention[[c in "0123456789" for c in mention].index(True)] * (own - len(d)) + d  # a country's 1 that the canonical form lacks
        it = iter(d)
        return "".join(next(it) if c in "0123456789" else c for c in mention)
    if kind == "iban":
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in mention)
    if kind == "ip6":
        full = all(len(g) == 4 for g in mention.split(":"))
        new = new if full else str(ipaddress.IPv6Address(new)) if "::" in mention else ":".join(f"{int(g, 16):x}" for g in new.split(":"))
    if mention.isupper():
        return new.upper()
    if kind.startswith("unlisted:"):
        return new.title()
    if kind == "family" or kind in _LISTS:
        if len(new) == len(mention):  # letter by letter: McDonald, Jean-Paul
            return "".join(a.upper() if b.isupper() else a for a, b in zip(new, mention, strict=True))
        return new[:1].upper() + new[1:]
    if kind == "email" and len(new) == len(mention):
        return "".join(a.upper() if b.isupper() else a for a, b in zip(new, mention, strict=True))
    return new


def rewrite(text: str | None, key: str, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with all entities replaced, and their types in order."""
    if not text:
        return text, []
    out, at, kinds = [], 0, []
    for a, b, kind, canon in find(text):
        new, _ = surrogate(kind, canon, attempts.get((kind, canon), 0), key)
        out += [text[at:a], render(text[a:b], kind, new)]
        kinds.append(kind.split(":")[0])
        at = b
    return ("".join([*out, text[at:]]) if out else text), kinds


ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("canon", T.StringType())])
EXCEPTION = T.StructType([*ENTITY.fields, T.StructField("attempt", T.IntegerType())])
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
DRAWN = T.StructType([T.StructField("drawn", T.StringType()), T.StructField("size", T.DoubleType())])


def _arrow(run: Callable, kind: T.DataType, *names: str):
    run.__annotations__ = dict.fromkeys((*names, "return"), pa.Array)
    return F.arrow_udf(run, kind).asNondeterministic()


def _entities(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "canon": c} for k, c in dict.fromkeys(f[2:] for f in find(t.as_py() or ""))] for t in texts]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string())])))


def _draw(key: str):
    def run(kind: pa.Array, canon: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = [surrogate(k, c, a, key) for k, c, a in zip(kind.to_pylist(), canon.to_pylist(), attempt.to_pylist(), strict=True)]
        return pa.array([{"drawn": s, "size": float(min(n, 10**300))} for s, n in rows], pa.struct([("drawn", pa.string()), ("size", pa.float64())]))

    return _arrow(run, DRAWN, "kind", "canon", "attempt")


_SHAPED = pa.struct([("text", pa.string()), ("kinds", pa.list_(pa.string()))])


def _rewriter(key: str, shared):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(RESULT.names, rewrite(t.as_py(), key, shared.value), strict=True)) for t in texts], _SHAPED)

    return _arrow(run, RESULT, "texts")


def _rewriter_own(key: str):
    def run(texts: pa.Array, own: pa.Array) -> pa.Array:
        each = ({(e["kind"], e["canon"]): e["attempt"] for e in o.as_py() or ()} for o in own)
        return pa.array([dict(zip(RESULT.names, rewrite(t.as_py(), key, e), strict=True)) for t, e in zip(texts, each, strict=True)], _SHAPED)

    return _arrow(run, RESULT, "texts", "own")


@lru_cache(1)
def _random_key() -> str:
    return secrets.token_hex(32)


def key_of(spark: SparkSession, key: str | None = None) -> str:
    """The caller's key, the configured one, or a random one of this process."""
    return key or spark.conf.get("spark.vellumine.pii.key", None) or _random_key()


def exceptions(distinct: DataFrame, folder: str, key: str) -> DataFrame:
    """The collision checks over distinct entities (kind, canon): those that need a later attempt, with it."""
    draw, on = _draw(key), ["kind", "canon"]
    # a shape has its own permutation; its surrogates can meet those of the same shape alone
    shape = F.regexp_replace(F.regexp_replace("canon", "[0-9]", "0"), "[^0-9@.+:-]", "a")
    known = written(distinct.select(*on, shape.alias("shape"), F.lit(0).alias("attempt"), draw("kind", "canon", F.lit(0)).alias("d")), folder, "drawn-0")
    real = known.select("kind", F.col("canon").alias("drawn"), F.lit(True).alias("real"))
    k = 0
    while True:
        now = known.select("kind", "canon", "shape", "attempt", F.col("d.drawn").alias("drawn"), F.col("d.size").alias("size"))
        again = now.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "canon")).alias("keeps"), F.count("*").alias("n")).filter("n > 1").select("kind", "drawn", "keeps")
        bad = now.join(again, ["kind", "drawn"], "left").join(real, ["kind", "drawn"], "left")
        is_real = F.col("real").isNotNull() & (F.col("size") >= SMALL) & F.lit(k < ROUNDS)
        doubled = F.col("keeps").isNotNull() & ((F.col("keeps.canon") != F.col("canon")) | (F.col("keeps.attempt") != F.col("attempt")))
        bad = written(bad.filter(is_real | doubled).select("kind", "canon", "shape"), folder, f"bad-{k}")
        if bad.isEmpty():
            break
        k += 1
        if k < LAST:
            to = F.when(F.col("hit"), F.lit(k)).otherwise(F.col("attempt"))
            marked = known.drop("d").join(bad.drop("shape").withColumn("hit", F.lit(True)), on, "left")
        else:
            first = F.when(F.startswith("kind", F.lit("unlisted:")), F.lit(LETTERS)).otherwise(F.lit(0))
            to = F.when(F.col("hit"), first).otherwise(F.col("attempt"))
            marked = known.drop("d").join(bad.select("kind", "shape").distinct().withColumn("hit", F.lit(True)), ["kind", "shape"], "left")
        known = written(marked.select(*on, "shape", to.alias("attempt")).withColumn("d", draw("kind", "canon", "attempt")), folder, f"drawn-{k}")
        if k > LAST:  # whole shapes are back at their first attempt, free of collisions
            break
    return known.filter("attempt != 0").select(*on, "attempt")


def with_surrogates(docs: DataFrame, key: str | None = None, text: str = "text", max_exceptions: int = MAX_EXCEPTIONS) -> tuple[DataFrame, str]:
    """``docs`` with a struct (text, kinds) of the rewritten text and the replaced types; returns that column's name too."""
    spark = docs.sparkSession
    prepare(spark)
    folder, key = shared_dir(spark), key_of(spark, key)
    found = _arrow(lambda texts: _entities(texts), T.ArrayType(ENTITY), "texts")
    distinct = docs.select(F.explode(found(column(docs, text))).alias("e")).select("e.kind", "e.canon").distinct()
    late = written(exceptions(written(distinct, folder, "entities"), folder, key), folder, "exceptions")
    name = fresh(docs, "surrogates")
    if late.count() <= max_exceptions:
        shared = spark.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in late.collect()})  # bounded by max_exceptions
        return docs.withColumn(name, _rewriter(key, shared)(column(docs, text))), name
    row, own = fresh(docs, "row"), fresh(docs, "own")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), folder, "rows")
    said = rows.select(F.col(row), F.explode(found(column(rows, text))).alias("e")).select(row, "e.kind", "e.canon", (F.rand(7) * SALTS).cast("int").alias("salt"))
    salted = late.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = said.join(salted, ["kind", "canon", "salt"]).groupBy(row).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias(own))  # distinct entities of one text
    both = rows.join(each, row, "left")
    return both.withColumn(name, _rewriter_own(key)(column(both, text), F.col(own))).drop(row, own), name


def replaced(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with all texts rewritten, and no other change."""
    out, s = with_surrogates(docs, key, text)
    return out.select(*[F.col(f"`{s}`.text").alias(c) if c == text else column(out, c) for c in docs.columns])


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with surrogates in place of personal data, and how many of each type."""
    out, s = with_surrogates(table(spark, sf_dir, "documents"))
    n = lambda *kinds: F.size(F.filter(F.col(f"{s}.kinds"), lambda k: k.isin(*kinds))).cast("long")
    return out.select(
        "doc_id", F.col(f"{s}.text").alias("text"), F.size(f"{s}.kinds").cast("long").alias("n_entities"), n("email").alias("n_email"), n("phone").alias("n_phone"), n("ip", "ip6").alias("n_ip"),
        n("card").alias("n_card"), n("given", "family", "unlisted").alias("n_name"), n("ssn", "iban", "mac").alias("n_other"),
    )
