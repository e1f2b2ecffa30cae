"""Replacing personal data by keyed surrogates of the same type and format.

Detected are e-mail addresses, telephone numbers, payment cards, bank accounts
(IBAN), social security numbers, IP addresses of both versions, secrets (long
hexadecimal or mixed strings, keys with a well-known beginning) and personal
names (after a title, or a known given name before a capitalised word). A
surrogate is the original under a keyed permutation of all strings of its
format: digits stay digits, letters stay letters of their script, vowels vowels,
and case and punctuation are put back; given names are permuted within the known
names of their gender and script, other names within all others, octets within 0
to 255; a card passes its check digit if and only if the original does, an
account keeps its country and gets its own check digits, a telephone number
keeps its country's code, and a key its beginning.

The permutation makes the same entity the same surrogate everywhere, however it
is spaced, with or without the code of its country, and different entities of a
format different ones, without any state or shuffle, and has no fixed points.
clashes() checks this over a whole corpus; the registered query runs it on
digests and fails on a clash. Other spellings of an address of version 6 are
entities of their own, and characters without an alphabet here stay.

Defined cases: null texts stay null and have no entities; texts without
entities stay as they are; repeated rows repeat their result; other columns are
kept out; an empty table gives an empty result. Patterns run in linear time.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, table

#: The key of the registered query; callers bring their own.
DEMO_KEY = b"surrogates-1"

# Given names by gender and script (callers may bring more), titles by gender, vowels by script, calling codes of two digits.
NAMES = {
    ("f", "latin"): "Anna Maria Emma Julia Laura Sarah Sophie Claire Camille Elena Carmen Lucia Isabel Ingrid Petra Karin Heike Alice Emily Jessica Elizabeth Margaret Susan Linda Barbara Patricia Jennifer Nancy Karen Helen Sandra Donna Ruth Sharon Michelle Amy Angela Rebecca Amanda Charlotte Olivia Sofia Hannah Nicole Monika Sabine Ursula Birgit Gisela Françoise Monique Nathalie Isabelle Sylvie Pilar Dolores Teresa Rosa Ana Beatriz Giulia Francesca".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Pierre Michel Philippe Jacques Carlos Miguel Javier Antonio Hans Klaus Stefan Wolfgang William Richard Joseph Daniel Charles Christopher Matthew Anthony Steven Andrew Kenneth George Edward Brian Kevin Jason Ryan Jacob Eric Henry Samuel Benjamin Alexander Patrick Jürgen Günter Andreas Matthias Uwe Bernd Jean François Alain Laurent José Luis Manuel Francisco Pedro Giovanni Marco".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Анастасия Людмила".split(),
    ("m", "cyrillic"): "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Александр Павел Виктор Юрий".split(),
}
TITLES = {"f": "Mrs Ms Miss Madame Mme Frau Señora Sra Doña".split(), "m": "Mr Mister Monsieur Herr Señor Sr Don".split()}
VOWELS = frozenset("aeiouæœøı" "αεηιουω" "аеёиоуыэюяєіѣ")
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Blocks of letters: those with two cases by script, then those without.
CASED = {"latin": (0x61, 0x17F), "greek": (0x3AC, 0x3CE), "cyrillic": (0x430, 0x45F), "armenian": (0x561, 0x586)}
UNCASED = {"hebrew": (0x5D0, 0x5EA), "arabic": (0x621, 0x64A), "devanagari": (0x904, 0x939), "thai": (0xE01, 0xE30), "hiragana": (0x3041, 0x3096), "katakana": (0x30A1, 0x30FA), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7A3)}
HEX = "0123456789abcdef"


def alphabets() -> dict[str, tuple[str, int]]:
    """Of each digit and small letter its alphabet and place there: letters of a script, vowels and consonants, plain and accented apart."""
    groups: dict[tuple, list[str]] = {}
    for i in range(10):
        groups.setdefault(("digit",), []).append(str(i))
    for script, (lo, hi) in (CASED | UNCASED).items():
        for c in map(chr, range(lo, hi + 1)):
            kind = unicodedata.category(c)
            base = unicodedata.normalize("NFD", c)
            if kind == "Ll" and c.upper().lower() == c and len(c.upper()) == 1 and base == unicodedata.normalize("NFKD", c):
                groups.setdefault((script, base[0] in VOWELS, c == base and ord(c) not in range(0x80, 0x180)), []).append(c)
            elif kind == "Lo" and script in UNCASED:
                groups.setdefault((script,), []).append(c)
    made = ["".join(g) for g in groups.values() if len(g) > 1]
    return {c: (g, i) for g in made for i, c in enumerate(g)}


def ranges(kind: str, below: int) -> str:
    """The characters of a category as ranges of a pattern's class."""
    out: list[list[int]] = []
    for c in range(0x41, below):
        if unicodedata.category(chr(c)) == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(z))}" if z > a else "") for a, z in out)


PLACE = alphabets()
OF = {c: a for c, (a, _) in PLACE.items()}
GIVEN = {n: k for k, ns in NAMES.items() for n in ns}
KNOWN = {n.lower(): n for n in GIVEN}
UPPER, OTHER = ranges("Lu", 0x590), ranges("Lo", 0xD7A4)
CAPITAL = rf"(?:[{UPPER}][\w'’-]+|[{OTHER}]\w*)"
#: What every entity has one of; separate searches, as either skips fast over all else.
MAYBE = (re.compile(r"[0-9@]").search, re.compile(rf"[{UPPER}]\w+\.? [{UPPER}{OTHER}]").search, re.compile(r"[0-9A-Za-z+/_-]{32}").search)
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Long runs are entered at their beginning only, so that no pattern looks at a run again from each of its characters.
FIND = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+)"
    rf"|(?P<ip>(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w]|\.\d))"
    r"|(?P<ip6>(?<![\w:.])(?=(?:[0-9a-fA-F]{0,4}:){3})(?=[a-fA-F:]{0,38}\d)[0-9a-fA-F:]{6,39}(?![\w:]))"
    r"|(?P<secret>(?<![0-9A-Za-z+/_-])(?:(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])"
    r"|(?P<begin>A[KS]IA|[spr]k[_-](?:live[_-]|test[_-]|proj[_-])?|gh[pousr]_|xox[abprs]-)(?=[A-Za-z_-]{0,40}\d)[0-9A-Za-z_-]{16,}"
    r"|(?=[^\W_a-z]*[a-z])(?=[^\W_A-Z]*[A-Z])(?=[A-Za-z+/_-]*\d)[0-9A-Za-z+/_-]{40,}))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d]))"
    r"|(?P<name>\b(?:(?P<title>" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? (?P<titled>" + CAPITAL + r"(?: " + CAPITAL + r")?)"
    r"|(?P<given>" + "|".join(sorted(GIVEN, key=len, reverse=True)) + r") (?P<family>" + CAPITAL + r")))"
)
KINDS = ("email", "ip", "ip6", "secret", "iban", "phone", "ssn", "card", "name")


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self.cycles: dict[tuple[str, int], list[int]] = {}
        self.kept: dict[tuple[str, str], str] = {}

    def stream(self, *of, n: int) -> list[int]:
        """n keyed numbers of 64 bits."""
        seed = hmac.new(self.key, repr(of).encode(), hashlib.sha256).digest()
        return list(memoryview(hashlib.shake_128(seed).digest(8 * n)).cast("Q"))

    def permute(self, tag: str, values: list[int], radices: list[int]) -> list[int]:
        """A keyed permutation of the vectors with these radices that leaves none in place: mixed, moved on by a keyed step, mixed back."""
        if len(values) < 2:  # one digit: the radix in an order of keyed marks
            return [self.following(tag, radices[0])[v] for v in values]
        out = self.mixed(tag, values, radices)
        step = [x % r for x, r in zip(self.stream(tag, -1, n=len(out)), radices, strict=True)]
        if not any(step):
            step = [min(1, r - 1) for r in radices]
        return self.mixed(tag, [(v + x) % r for v, x, r in zip(out, step, radices, strict=True)], radices, back=True)

    def following(self, tag: str, radix: int) -> list[int]:
        """What comes after each number below radix in a keyed cycle of them all."""
        if (tag, radix) not in self.cycles:
            marks = self.stream(tag, -2, n=radix)
            order = sorted(range(radix), key=lambda v: (marks[v], v))
            after = [0] * radix
            for a, b in zip(order, [*order[1:], order[0]], strict=True):
                after[a] = b
            if len(self.cycles) > 500:
                self.cycles.clear()
            self.cycles[tag, radix] = after
        return self.cycles[tag, radix]

    def mixed(self, tag: str, values: list[int], radices: list[int], back: bool = False) -> list[int]:
        """Ten Feistel rounds over the two halves of a vector, each place moved within its radix, or those rounds undone."""
        mid, sign = len(values) // 2, -1 if back else 1
        half, sizes = [values[:mid], values[mid:]], [radices[:mid], radices[mid:]]
        for turn in reversed(range(10)) if back else range(10):
            side = turn % 2
            moves = self.stream(tag, turn, half[1 - side], n=len(half[side]))
            half[side] = [(v + sign * x) % r for v, x, r in zip(half[side], moves, sizes[side], strict=True)]
        return half[0] + half[1]

    def letters(self, tag: str, text: str, digits: str = "") -> str:
        """Every known letter and digit permuted within its alphabet; the rest and the case stay."""
        low = text.lower() if len(text.lower()) == len(text) else text
        own = [digits if digits and c in digits else OF.get(c) for c in low]
        at = [i for i, a in enumerate(own) if a]
        form = hashlib.sha256("".join(a[0] if a else c for a, c in zip(own, low, strict=True)).encode()).hexdigest()[:16]
        values = self.permute(f"{tag}|{form}", [own[i].index(low[i]) if own[i] is digits else PLACE[low[i]][1] for i in at], [len(own[i]) for i in at])
        out = list(text)
        for i, v in zip(at, values, strict=True):
            c = own[i][v]
            up = c.upper()
            out[i] = up if text[i] != low[i] and len(up) == 1 else c
        return "".join(out)

    def digits(self, tag: str, text: str, skip: int = 0, check: bool = False) -> str:
        at = [i for i, c in enumerate(text) if c.isdigit()][skip:]
        body = [int(text[i]) for i in at]
        luhn = check and passes(body)
        body = body[:-1] if luhn else body
        body = self.permute(f"{tag}|{len(at)}|{luhn}", body, [10] * len(body))
        while check and not luhn and passes(body):  # those that pass stand for those that pass
            body = self.permute(f"{tag}|{len(at)}|{luhn}", body, [10] * len(body))
        if luhn:
            body = [*body, next(d for d in range(10) if passes([*body, d]))]
        out = list(text)
        for i, d in zip(at, body, strict=True):
            out[i] = str(d)
        return "".join(out)

    def name(self, text: str) -> str:
        """Known given names stay among those of their kind, and others among the others; the last of several words is a family name."""
        words, out = text.split(" "), []
        for i, w in enumerate(words):
            first = i < len(words) - 1 or len(words) == 1
            if first and (known := KNOWN.get(w.lower())):
                kind = GIVEN[known]
                names = NAMES[kind]
                new = names[self.permute(f"given|{kind}", [names.index(known)], [len(names)])[0]]
                out.append(new.upper() if w.isupper() else new)
                continue
            new = self.letters("name", w)
            while first and new.lower() in KNOWN:
                new = self.letters("name", new)
            out.append(new)
        return " ".join(out)

    @staticmethod
    def cased(new: str, old: str) -> str:
        return new.upper() if old.isupper() else new

    def account(self, text: str) -> str:
        """Another account of the country, with its own check digits."""
        old = text.replace(" ", "")
        body = self.letters(f"iban|{old[:2]}", old[4:])
        new = iter(f"{old[:2]}{98 - remainder(body + old[:2] + '00'):02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)

    def of(self, kind: str, text: str, m: re.Match | None = None) -> str:
        if kind == "email":
            local, _, domain = text.partition("@")
            labels, _, top = domain.rpartition(".")
            return f"{self.letters('local', local)}@{self.letters('domain', labels)}.{top}"
        if kind == "ip":
            return ".".join(map(str, self.permute("ip", list(map(int, text.split("."))), [256] * 4)))
        if kind == "ip6":
            return self.cased(self.letters("ip6", text.lower(), HEX), text)
        if kind == "secret":
            begin = m["begin"] if m and m["begin"] else ""
            if begin or not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
                return begin + self.letters(f"secret|{begin}", text[len(begin) :])
            return self.cased(self.letters("secret", text.lower(), HEX), text)
        if kind == "iban":
            return self.account(text)
        if kind == "ssn":
            return self.digits("ssn", text)
        if kind == "phone":
            d = re.sub(r"\D", "", text)
            code = 0 if text[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in TWO_DIGIT_CODES else 3
            return self.digits("phone", text, code)
        if kind == "card":
            return self.digits("card", text, check=True)
        if m and m["titled"]:
            at = m.start("titled") - m.start()
            return text[:at] + self.name(m["titled"])
        return self.name(text)

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, original, surrogate) of each place."""
        if not any(may(text) for may in MAYBE):
            return text, []
        lines, found = text.split("\n"), []  # no entity spans lines
        for i, line in enumerate(lines):
            if any(may(line) for may in MAYBE):
                lines[i] = FIND.sub(lambda m: self.met(m, found), line)
        return "\n".join(lines), found

    def met(self, m: re.Match, found: list[tuple[str, str, str]]) -> str:
        kind = next(k for k in KINDS if m[k] is not None)
        if kind == "iban" and (a := m[0].replace(" ", "")) and remainder(a[4:] + a[:4]) != 1 or kind == "ip6" and not address(m[0]):
            return m[0]
        new = self.kept.get((kind, m[0]))
        if new is None:
            if len(self.kept) > 50_000:
                self.kept.clear()
            new = self.of(kind, m[0], m)
            if len(m[0]) < 100:
                self.kept[kind, m[0]] = new
        found.append((kind, m[0], new))
        return found[-1][2]


def remainder(account: str) -> int:
    """The check of bank accounts: letters as two digits, by 97."""
    return int("".join(str(int(c, 36)) for c in account)) % 97


def address(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def passes(digits: list[int]) -> bool:
    """The check of payment cards."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def anonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities, entities (kind, original, surrogate)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = Surrogates(key)
        entity = pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))
        for b in batches:
            text, n, found = [], [], []
            for t in b.column(1):
                new, own = s.replace(t.as_py()) if t.is_valid else (None, [])
                text.append(new)
                n.append(len(own))
                found.append([dict(zip(("kind", "original", "surrogate"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(found, entity)], names=["doc_id", "text", "n_entities", "entities"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_entities bigint, entities array<struct<kind:string,original:string,surrogate:string>>")


def plain(kind: Column, text: Column) -> Column:
    """An entity apart from case, the punctuation of numbers and the titles of names."""
    low = F.lower(text)
    titles = "|".join(t.lower() for ts in TITLES.values() for t in ts)
    name = F.regexp_replace(low, rf"^({titles})\.? ", "")
    return F.when(kind == "name", name).when(kind.isin("phone", "card", "iban", "ssn"), F.regexp_replace(low, r"[\s().-]", "")).otherwise(low)


def marked() -> Column:
    """Of each entity its kind and digests of its plain original and surrogate."""
    return F.transform("entities", lambda e: F.struct(e.kind.alias("kind"), *[F.unhex(F.substring(F.sha2(plain(e.kind, e[c]), 256), 1, 32)).alias(c) for c in ("original", "surrogate")]))


def shared(places: DataFrame) -> DataFrame:
    return places.distinct().groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("originals")).where("originals > 1")


def clashes(done: DataFrame) -> DataFrame:
    """kind and surrogate where different originals, apart from case, punctuation and titles, share one."""
    places = done.select(F.explode("entities").alias("e")).select("e.*")
    return shared(places.select("kind", *[plain(F.col("kind"), F.col(c)).alias(c) for c in ("original", "surrogate")]))


def checked(done: DataFrame) -> DataFrame:
    """doc_id, text, n_entities and the kinds that were found, once no two entities share a surrogate. Originals are held as digests only."""
    kinds = F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds")
    held = cut(done.select("doc_id", "text", "n_entities", kinds, marked().alias("marks")), "surrogates")
    if not (bad := shared(held.select(F.explode("marks").alias("m")).select("m.*"))).isEmpty():
        raise ValueError(f"{bad.count()} surrogates stand for different originals")
    return held.drop("marks")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals stay out of the result: doc_id, text, n_entities and the kinds that were found."""
    return checked(anonymised(table(spark, sf_dir, "documents"), DEMO_KEY))
