"""Personal information inside free text (problem 9).

Candidates are found by shape.  Whether a candidate reveals a person is decided
by what the corpus says of its terms and its context: the pointwise mutual
information between a term and the protected entities that are beyond doubt (an
e-mail address names its owner), and the share of a context's candidates that
are beyond doubt.  Terms above the disclosure thresholds are generalised, that
is replaced by a placeholder of their type.  All statistics are over all
different texts, so copies of a text count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeweft.sources.tables import cut_lineage

#: A term names a person if it tells this share of all there is to know about an occurrence lying in an address: the pointwise
#: mutual information of the two over the information of the latter, log2(P(address | term) / P(address)) / -log2 P(address).
TERM_TOLD = 0.59
#: Share from which on a given name reveals the rare proper word after it without any context.
GIVEN_TOLD = 0.8
#: Share of a context's candidates that are beyond doubt from which on the context reveals the others.
CONTEXT_DISCLOSURE = 0.15
#: Share of a word's occurrences in lower case up to which it can be a family name told by context only.
COMMON_WORD = 0.2
#: Bits of information two capital words must carry to be a name by context only: -log2 of the share of texts that hold the pair.
PAIR_BITS = 7.0
#: ... or this many texts at most, which in a small corpus are few bits.
RARE_PAIR = 2
#: Bits of the mask of disclosing terms, 1 MB whatever the data; an exact join follows it.
MASK_BITS = 1 << 23
#: Keys with this share of the rows and more are looked up by broadcast; there are at most 1/share of them.
HOT_SHARE = 0.001

_AT = r"(?:[ \t]*(?:\[at\]|\(at\)|\{at\}|<at>|\(a\)|\[a\])[ \t]*|[ \t]+(?:at|AT|At)[ \t]+)"
_DOT = r"(?:[ \t]*(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\[\.\]|\(\.\))[ \t]*|[ \t]+(?:dot|DOT|Dot)[ \t]+)"
_LOCAL = r"(?<![\w@/.+-])[A-Za-z0-9À-ɏ](?:[\w.+%-]*[\w])?"
EMAIL = re.compile(
    rf"{_LOCAL}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?![\w@-])(?!:[\w./~])(?!/)"
    rf"|{_LOCAL}{_AT}[A-Za-z][\w-]*(?:{_DOT}[A-Za-z][\w-]*)+(?![\w@])",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(?\d{1,8}\)?){1,6}"  # +49 30 23125 919, +16175550133
    r"|00[1-9]\d{0,2}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\d{1,8}){2,6}"  # 0049 (0)30 23125-041
    r"|(?:1[ .-])?\(\d{2,5}\)[ ]?\d{3,4}[ .\-]?\d{3,5}(?:[ .\-]\d{2,4})?"  # (415) 555-0106
    r"|(?:1[ .-])?\d{3}([.\-])\d{3}\1\d{4}"  # 206.555.0126
    r"|0\d{1,4}[/\-]\d{4,9}(?:-\d{1,4})?"  # 030/23125664
    r"|0\d{1,4}(?: \d{2,4}){2,4}|0\d{3,4} \d{5,8}"  # 020 7946 0547, 07700 900770
    r")(?![\w])(?![.\-/]\d)"
)
PHONE_WEAK = re.compile(r"(?<![\w.+/-])(?:0\d{8,11}|\d{3} \d{3} \d{4}|[1-9]\d{9})(?![\w])(?![.\-/]\d)")
ID_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{3}([ -])\d{2}\1\d{4}"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r")(?![\w])(?![.\-/]\d)"
)
ID_WEAK = re.compile(r"(?<![\w.+/-])(?:\d{9}|\d{11})(?![\w])(?![.\-/]\d)")

# Kinds of streets.
_STREET = r"(?i:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Boulevard|Blvd\.?|Avenue|Ave\.?|Way|Place|Pl\.?|Close|Terrace|Square|Crescent|Row|Hill|Gardens?|Walk|Parkway|Alley)"
_CAP = r"(?:[A-ZÀ-Þ][\w'’-]*)"
_POST = r"(?:[A-Z]{1,2} \d{4,5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{4,5}(?:-\d{3,4})?)"
_UNIT = r"(?:(?i:Apt|Apartment|Unit|Suite|Ste|Room|Floor)\.? ?#?\d+[A-Za-z]?|#\d+)"
_SEP = r"(?:,[ \t]*\n?[ \t]*|[ \t]*\n[ \t]*)"
# A town after its postal code ends with its first word: what follows may be the next sentence.
_TOWN = rf"(?:(?i:Bad|Sankt|St\.|Saint|Sainte|San|Santa|Los|Las|La|Le|Les|New|Villa|Castel) )?{_CAP}"
ADDRESS = re.compile(
    r"(?<![\w.])(?:"
    # Flat 17, 444 Larch Road, Quenstead, QV6 6ZX; 803 Pewter Drive, Apt 25, Pellworth, ZQ 27719
    rf"(?:(?i:Flat|Apartment|Apt\.?|Unit|Suite|Room) \d+[A-Za-z]?{_SEP})?\d{{1,5}}[A-Za-z]? {_CAP}(?: {_CAP}){{0,2}} {_STREET}(?:{_SEP}{_UNIT})?{_SEP}{_CAP}(?: {_CAP}){{0,2}}(?:{_SEP}| ){_POST}"
    # 576, rue du Heron, 36268 Saintmere
    rf"|\d{{1,4}}(?: ?(?i:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai)(?: (?i:de|du|des|la|le|les|l'))*[ ']{_CAP}(?: {_CAP}){{0,2}}{_SEP}{_POST} {_TOWN}"
    # Calle Cobbler 71, 79417 Castelvento
    rf"|(?i:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Rua|Via|Viale|Piazza|Corso|Travessa|Praça)(?: (?i:de|del|della|dei|da|do|dos|la|las|los|el))* {_CAP}(?: {_CAP}){{0,2}},? \d{{1,4}}[A-Za-z]?{_SEP}{_POST} {_TOWN}"
    # Alderstraße 477, 67569 Lowfen
    rf"|(?:[A-ZÀ-Þ][\wÀ-ɏ-]*(?i:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|ring|damm|laan|straat)|{_CAP}[ -](?i:Stra(?:ß|ss)e|Str\.|Weg|Gasse|Platz|Allee)) \d{{1,4}}[A-Za-z]?{_SEP}{_POST} {_TOWN}"
    r")(?![\w])"
)

_WORD = re.compile(r"[^\W\d_]+")
_PART = r"(?:[^\W\d_]['’])?[^\W\d_]{2,}"
#: A capital inside a word makes it an identifier of code, but for names such as McKay and DeWitt.
_CAMEL = re.compile(r"(?<!\bMc)(?<!\bMac)(?<!\bDe)(?<!\bDi)(?<!\bLe)(?<!\bLa)(?<!\bVan)(?<=[^\W\d_A-ZÀ-Þ])[A-ZÀ-Þ]")
_PARTICLES = {"van", "von", "de", "der", "den", "del", "della", "di", "da", "du", "dos", "la", "le", "ten", "ter", "zu", "zum", "zur", "af", "bin", "ibn", "al", "el"}
_TOKEN = re.compile(r"(?:[^\W\d_]['’])?[^\W\d_]{2,}(?:-(?:[^\W\d_]['’])?[^\W\d_]{2,})*|[^\W\d_]\.|[^\s]", re.S)
_SHAPES = (("email", EMAIL, True), ("address", ADDRESS, True), ("phone", PHONE, True), ("id_number", ID_NUMBER, True), ("phone", PHONE_WEAK, False), ("id_number", ID_WEAK, False))


def fold(word: str) -> str:
    """Lower case without accents, as in e-mail addresses."""
    w = word.lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae")
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def _digits(s: str) -> int:
    return sum(map(s.count, "0123456789")) if s.isascii() else sum(c.isdigit() for c in s)


_SPELLED_DOT = re.compile(r"dot|\[\.\]|\(\.\)", re.I)
_SPELLED_AT = re.compile(r"\bat\b|\(a\)|\[a\]", re.I)
_NUMBERS = re.compile(r"[+(]?\d[\d ().\-/]{6,}")
_INSURED = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]")
#: A postal code as it stands in an address: after a capital word, or between a comma or line end and a word.
_POSTAL = re.compile(rf"\b[A-ZÀ-Þ][\w'’-]*(?:{_SEP}| ){_POST}(?!\w)|{_SEP}{_POST} [^\W\d_]")
#: A street as it stands in an address of any of the forms of ADDRESS.
_STREETS = re.compile(
    rf"{_CAP} {_STREET}[ \t]*[,\n]|\d(?: ?(?i:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\b"
    r"|\b(?i:calle|avenida|avda|plaza|paseo|camino|rua|via|viale|piazza|corso|travessa|praça)\b|\b[Cc]/"
    r"|(?i:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|ring|damm|laan|straat) \d"
)


def _windows(kind: str, text: str, numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a text in which alone a shape of the kind can lie: all of it, or what is around a sign every such shape has."""
    if kind == "email":
        at = text.find("@")
        if at >= 0:
            done = 0
            while at >= 0:
                a, b = at, at
                while a > done and not text[a - 1].isspace():
                    a -= 1
                while b < len(text) and not text[b].isspace():
                    b += 1
                yield a, b
                done = b
                at = text.find("@", b)
        if _SPELLED_DOT.search(text) and _SPELLED_AT.search(text):
            yield 0, len(text)
    elif kind == "address":  # at most five lines, with the postal code in the last
        spans: list[list[int]] = []
        for m in _POSTAL.finditer(text):
            if spans and m.end() <= spans[-1][1]:
                continue
            a = m.end()
            for _ in range(6):
                a = text.rfind("\n", 0, max(a - 1, 0)) + 1
            b = text.find("\n", m.end())
            b = len(text) if b < 0 else b
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            if _STREETS.search(text, a, b):
                yield a, b
    else:
        yield from numbers
        if kind == "id_number":
            for m in _INSURED.finditer(text):
                yield m.start(), min(len(text), m.end() + 2)


def shaped(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, beyond doubt) of the entities told by shape, without overlaps; earlier shapes in _SHAPES win."""
    taken: list[tuple[int, int, str, bool]] = []
    numbers = [(m.start(), min(len(text), m.end() + 2)) for m in _NUMBERS.finditer(text)]
    for kind, pattern, sure in _SHAPES:
        for a, b in _windows(kind, text, numbers):
            for m in pattern.finditer(text, a, b):
                s, e = m.span()
                if kind == "phone" and not 8 <= _digits(m.group()) <= 15:
                    continue
                if kind == "email" and "@" not in m.group() and not re.search(r"[^\w][dD][oO][tT][^\w]|\.\]|\.\)", m.group()):
                    continue
                if all(e <= x or y <= s for x, y, *_ in taken):
                    taken.append((s, e, kind, sure))
    return taken


def mail_terms(address: str) -> list[str]:
    local = re.split(r"@|[\[({< ]", address, maxsplit=1)[0]
    out = []
    for t in re.findall(r"[^\W\d_]+", fold(local)):
        if len(t) > 2:
            out.append(t)
        if len(t) > 4:
            out.append(t[1:])  # an initial may stand before the family name
    return out


_LEFT_TOKEN = re.compile(r"[\w'’-]+[^\w\s]?|[^\w\s]")
_RIGHT_TOKEN = re.compile(r"[\w'’-]+|[^\w\s]")
_TAIL = re.compile(r"(?:(?:[\w'’-]+[^\w\s]?|[^\w\s])\s*){0,3}\Z")
_DIGIT = re.compile(r"\d")
_BEFORE_MAIL = re.compile(r"[ \t]*[,(<\[]?[ \t]*")


def _left(text: str, at: int) -> tuple[str, str]:
    """The last token and the last two tokens before ``at`` in its line, digits as 0; a line start shows as ^."""
    begin = text.rfind("\n", 0, at) + 1
    low = at
    toks: list[str] = []
    while len(toks) < 3 and low > begin:  # twice as far back until there are tokens enough, so that the first of them is whole
        low = max(begin, at - 2 * (at - low) - 40)
        toks = _LEFT_TOKEN.findall(_DIGIT.sub("0", text[low:at].lower()))
    if low == begin and len(toks) < 2:
        toks = ["^", *toks]
    return toks[-1] if len(toks) > 1 else "^", " ".join(toks[-2:])


def _right(text: str, at: int) -> str:
    """The two tokens after ``at`` in its line, or <mail> if an address follows at once."""
    after = _BEFORE_MAIL.match(text, at).end()
    if "@" in text[after : after + 320].split("\n", 1)[0] or _SPELLED_AT.search(text, after, after + 80):
        if EMAIL.match(text, after):
            return "<mail>"
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    toks: list[str] = []
    high = at
    while len(toks) < 3 and high < end:
        high = min(end, at + 2 * (high - at) + 40)
        toks = _RIGHT_TOKEN.findall(_DIGIT.sub("0", text[at:high].lower()))
    return " ".join(toks[:2]) or "$"


_PARTICLE = "(?i:" + "|".join(sorted(_PARTICLES, key=len, reverse=True)) + ")"
_NAME_WORD = r"(?:[^\W\d_]['’])?[^\W\d_]{2,}(?:-(?:[^\W\d_]['’])?[^\W\d_]{2,})*"
_NAME_END = r"(?![\w@/\\(]|\.\w|['’-]\w)"
_BIG = "(?=[A-ZÀ-ÖØ-Þ\u0100-\u024f\u0370-\u03ff\u0400-\u042f])"


def _pair_pattern(start: str) -> re.Pattern:
    return re.compile(
        rf"(?<![\w@/.\\'’-])(?={start}({_NAME_WORD}){_NAME_END}(?:,[ \t]{{1,2}}({_NAME_WORD}){_NAME_END}( [^\W\d_]\.(?!\w))?"
        rf"|[ \t]{{1,2}}(?:(?:[^\W\d_]\.|{_PARTICLE}{_NAME_END})[ \t]{{1,2}})*({_NAME_WORD}){_NAME_END}))"
    )


_PAIRS_BIG, _PAIRS_ANY = _pair_pattern(_BIG), _pair_pattern("")


def name_pairs(text: str, taken: list[tuple[int, int, str, bool]], small: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, given, family) of every run of words shaped like a personal name, overlapping ones too.

    Given name [initials, particles] family, or family, given [initial]; a family
    name may be double.  Both words begin with a capital; with ``small`` the pairs
    come instead of which a word does not, and they count only if both disclose.
    """
    for s, e, *_ in taken:
        text = f"{text[:s]}{chr(10) * (e - s)}{text[e:]}"
    out = []
    for m in (_PAIRS_ANY if small else _PAIRS_BIG).finditer(text):
        first, given, initial, family = m.groups()
        last = given or family
        if (first[0].isupper() and last[0].isupper()) == small or _CAMEL.search(first) or _CAMEL.search(last):
            continue
        if given is None:
            out.append((m.start(1), m.end(4), first, family))
        else:
            if initial and (small or initial[1].isupper()):
                out.append((m.start(1), m.end(3), given, first))
            out.append((m.start(1), m.end(2), given, first))
    return out


def _family_terms(family: str) -> list[str]:
    return [fold(p.split("'")[-1].split("’")[-1]) for p in family.split("-")]


_SCAN = "th string, kind string, start bigint, stop bigint, found_text string, given string, family string, left1 string, left2 string, right2 string, sure boolean, term string, n_text bigint, n_lower bigint, n_mail bigint"
_SCAN_COLUMNS = [c.split()[0] for c in _SCAN.split(", ")]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of every text, and the counts of the words of each batch (rows of which only term and the counts are set)."""
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _SCAN.split(", ")])
    for b in batches:
        rows, mails, kept = [], Counter(), []
        for th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            taken = shaped(text)
            for s, e, given, family in name_pairs(text, taken):
                rows.append((th, "person_name", s, e, text[s:e], fold(given.split("-")[0]), _family_terms(family)[0], *_left(text, s), _right(text, e), False))
            for s, e, kind, sure in taken:
                rows.append((th, kind, s, e, text[s:e], None, None, *_left(text, s), _right(text, e), sure))
            for s, e, kind, _ in taken:
                if kind == "email":
                    mails.update(mail_terms(text[s:e]))
                    text = f"{text[:s]}{' ' * (e - s)}{text[e:]}"
            kept.append(text)
        words, lower = Counter(), Counter()
        for w, k in Counter(_WORD.findall("\n".join(kept))).items():
            t = fold(w)
            words[t] += k
            if w.islower():
                lower[t] += k
        if rows:
            cols = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))]
            cols += [pa.nulls(len(rows), schema.field(i).type) for i in range(len(cols), len(schema))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        terms = list(words.keys() | mails.keys())
        if terms:
            cols = [pa.nulls(len(terms), f.type) for f in schema][:11] + [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (words, lower, mails))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)


def _term_mask(terms: DataFrame) -> bytes:
    """A bit for the checksum of every term, MASK_BITS in all: what has no bit is no term."""
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(MASK_BITS))
    byte = terms.select(F.floor(bit / 8).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    out = bytearray(MASK_BITS // 8)
    for r in byte.collect():  # at most MASK_BITS / 8 rows
        out[r.i] = r.b
    return bytes(out)


def _near(said: list[str], known: set[str], double: bool) -> bool:
    """Do two known words, not both with a capital, stand so that they can be a name? What may stand between them: particles, initials, and in double names anything."""
    last = -1
    for i, w in enumerate(said):
        if w in known:
            if last >= 0 and not (w[0].isupper() and said[last][0].isupper()) and (double or all(len(x) == 1 or x.lower() in _PARTICLES for x in said[last + 1 : i])):
                return True
            last = i
    return False


def _small_candidates(mask: bytes):
    """Pairs of words of the mask that do not both begin with a capital; the mask takes some other words too."""

    def hit(term: str) -> bool:
        bit = zlib.crc32(term.encode()) % MASK_BITS
        return bool(mask[bit >> 3] >> (bit & 7) & 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[str] = set()
        other: set[str] = set()
        for b in batches:
            rows = []
            for th, text in zip(b["th"], b["_text"]):
                said = _WORD.findall(text)
                words = set(said)
                fresh = words - known - other
                if fresh:
                    yes = {w for w in fresh if hit(fold(w))}
                    known |= yes
                    other |= fresh - yes
                if len(words & known) > 1 and _near(said, known, "-" in text):
                    for s, e, given, family in name_pairs(text, shaped(text), True):
                        g, f = fold(given.split("-")[0]), _family_terms(family)[0]
                        if hit(g) and hit(f):
                            rows.append((th, s, e, text[s:e], g, f))
                if len(other) > 500_000:
                    other.clear()
            yield pd.DataFrame(rows, columns=["th", "start", "stop", "found_text", "given", "family"])

    return run


def _look_up(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left join with ``right`` (unique by keys, texts): its heavy keys by weight, whose sum is total at most, are broadcast: 1/HOT_SHARE of them at most.

    Rows that found their key there are spread in the shuffle for the others.
    """
    heavy = F.col(weight) >= HOT_SHARE * total
    values = [c for c in right.columns if c not in (*keys, weight)]
    hot = F.broadcast(right.where(heavy).select(*keys, *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_hit")))
    rest = right.where(~heavy).select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_r_{v}") for v in values])
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*left.columns), F.lit(4096)).cast("string"))
    found = left.join(hot, keys, "left").withColumn("_first", F.when(F.col("_hit"), spread).otherwise(F.col(keys[0])))
    same = F.col("_first") == F.col(f"_k_{keys[0]}")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return found.join(rest, same, "left").select(*left.columns, *[F.coalesce(f"_h_{v}", f"_r_{v}").alias(v) for v in values])


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, pii_kind, start, stop, found_text): every personal entity of every document, without overlaps.

    docs: doc_id, text, other columns ignored; positions count code points.  Null
    and empty texts hold nothing.  Copies of a text give the same rows under each
    doc_id, and count once in the statistics, which are over all texts.  A corpus
    without any e-mail address has no terms that disclose names; the four other
    kinds do not need them.
    """
    src = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long"), F.sha2("text", 256).alias("th"), F.col("text").alias("_text"))
    # Copies go before the shuffle and after it; the texts are gone after this step.
    texts = src.groupBy("_text").agg(F.first("th").alias("th")).select("th", "_text")
    scan = cut_lineage(texts.mapInArrow(_scan, _SCAN))
    terms = (
        scan.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_text").alias("n_text"), F.sum("n_lower").alias("n_lower"), F.sum("n_mail").alias("n_mail"))
    )
    terms = cut_lineage(terms)
    all_mail, all_words = terms.agg(F.sum("n_mail"), F.sum(F.col("n_text") + F.col("n_mail"))).first()
    all_words = all_words or 1
    base = min((all_mail or 0) / all_words or 0.5, 0.999)
    occurs = F.col("n_text") + F.col("n_mail")
    share = F.col("n_mail") / occurs
    # terms in no address are far below any threshold
    terms = terms.select("term", F.when(F.col("n_mail") > 0, F.log2(share / F.lit(base)) / F.lit(-math.log2(base))).otherwise(F.lit(-99.0)).alias("told"), (F.col("n_lower") / F.greatest("n_text", F.lit(1))).alias("lower"), occurs.alias("n"))
    none = F.lit(0.0)
    cand = scan.where("term IS NULL").drop("term", "n_text", "n_lower", "n_mail")
    person = F.col("kind") == "person_name"
    # What two words are is asked once for each pair, however often it occurs.
    n_texts, n_docs = src.agg(F.count_distinct("th"), F.count(F.lit(1))).first()
    n_names, n_others = cand.agg(F.count_if(person), F.count_if(~person)).first()
    pair = cand.where(person).groupBy("given", "family").agg(F.count_distinct("th").alias("df"))
    useful = terms.where(f"told > -99 OR lower <= {COMMON_WORD}")
    pair = _look_up(pair, useful.select(F.col("term").alias("given"), F.col("told").alias("g"), "n"), ["given"], "n", all_words)
    pair = _look_up(pair, useful.select(F.col("term").alias("family"), F.col("told").alias("f"), "lower", "n"), ["family"], "n", all_words)
    proper = F.coalesce(F.col("lower") <= COMMON_WORD, F.lit(False)) & F.col("g").isNotNull()
    rare = (F.col("df") <= RARE_PAIR) | (F.col("df") <= F.lit(n_texts / 2.0**PAIR_BITS))
    # Words that differ but in case from running text are no names; pairs not in capitals come in below.
    pair = cut_lineage(pair.where(proper).select("given", "family", "df", F.coalesce("g", F.lit(-99.0)).alias("g"), F.coalesce("f", F.lit(-99.0)).alias("f"), rare.alias("rare")))
    # Pairs whose words cannot be names stay, as they count in their contexts.
    names = _look_up(cand.where(person), pair, ["given", "family"], "df", n_names)
    known = ((F.col("f") >= TERM_TOLD) & (F.col("g") > -99)) | (F.col("right2") == "<mail>")
    names = names.withColumns({"sure": F.col("rare").isNotNull() & known, "open": F.coalesce("rare", F.lit(False))})
    others = cand.where(~person).withColumns({"g": none, "f": none, "rare": F.lit(False), "open": F.lit(True)})
    cand = cut_lineage(names.unionByName(others).withColumn("cid", F.monotonically_increasing_id()))
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("said")) for c in ("left1", "left2", "right2")]))

    def with_context(c: DataFrame) -> DataFrame:
        """ctx: the greatest share of sure candidates among those with the same word before, two words before, or words after."""
        c = c.drop("ctx")
        at = c.select("cid", "kind", "sure", sides.alias("s")).select("cid", "kind", "sure", "s.side", "s.said")
        per = at.groupBy("kind", "side", "said").agg(F.count_if("sure").alias("_s"), F.count(F.lit(1)).alias("_n")).where("_s > 0")
        per = per.select("said", "kind", "side", (F.col("_s") / (F.col("_n") + 1)).alias("_share"), "_n")
        best = _look_up(at.drop("sure"), per, ["said", "kind", "side"], "_n", n_names + n_others).groupBy("cid").agg(F.max("_share").alias("ctx"))
        return c.join(best, "cid", "left").withColumn("ctx", F.coalesce("ctx", none))

    accepted = F.col("open") & ((F.col("ctx") >= CONTEXT_DISCLOSURE) | ((F.col("kind") == "person_name") & (F.col("g") >= GIVEN_TOLD)))
    # Contexts of what is beyond doubt reveal more, and the contexts of that yet more.
    for _ in range(2):
        cand = cut_lineage(with_context(cand).withColumn("sure", F.col("sure") | accepted))
    scored = with_context(cand)

    def chance(told: str):
        return F.pow(F.lit(base), F.lit(1.0) - F.col(told))

    weight = F.when(F.col("kind") != "person_name", F.lit(9.0)).otherwise(chance("f") + chance("g") + F.col("ctx") + F.length("found_text") / 1000)
    disclosing = cut_lineage(terms.where(F.col("told") >= TERM_TOLD).select("term", "told", "n"))
    small = src.select("th", "_text").mapInPandas(_small_candidates(_term_mask(disclosing)), "th string, start bigint, stop bigint, found_text string, given string, family string").dropDuplicates(["th", "start", "stop", "given", "family"])
    small = _look_up(small, disclosing.select(F.col("term").alias("given"), F.col("told").alias("g"), "n"), ["given"], "n", all_words).where("g IS NOT NULL")
    small = _look_up(small, disclosing.select(F.col("term").alias("family"), F.col("told").alias("f"), "n"), ["family"], "n", all_words).where("f IS NOT NULL")
    small = small.select("th", (chance("f") + chance("g") + F.length("found_text") / 1000).alias("w"), "start", "stop", F.lit("person_name").alias("kind"), "found_text")
    taken = scored.where(F.col("sure") | accepted).select("th", weight.alias("w"), "start", "stop", "kind", "found_text").union(small)
    # The accepted candidates of one text only: a few per text.
    pick = F.pandas_udf(_pick, "array<struct<kind:string,start:bigint,stop:bigint,found_text:string>>")
    spans = cut_lineage(taken.groupBy("th").agg(F.collect_list(F.struct("w", "start", "stop", "kind", "found_text")).alias("c")).select("th", pick("c").alias("p")))
    copies = src.groupBy("th").agg(F.count(F.lit(1)).alias("n"))
    rows = _look_up(src.select("doc_id", "th"), spans.join(copies, "th"), ["th"], "n", n_docs)
    return rows.select("doc_id", F.explode("p").alias("p")).select("doc_id", F.col("p.kind").alias("pii_kind"), "p.start", "p.stop", "p.found_text")


def _pick(groups: pd.Series) -> pd.Series:
    """Of overlapping candidates the weightiest stays; equal weights: the earlier, then the longer."""
    out = []
    for c in groups:
        kept: list[dict] = []
        for x in sorted(c, key=lambda r: (-r["w"], r["start"], -r["stop"])):
            if all(x["stop"] <= k["start"] or k["stop"] <= x["start"] for k in kept):
                kept.append({k: x[k] for k in ("kind", "start", "stop", "found_text")})
        out.append(kept)
    return pd.Series(out)


def _replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, ss in zip(texts, spans):
        if text is not None and ss is not None:
            for s in sorted(ss, key=lambda r: -r["start"]):
                text = f"{text[: s['start']]}[{s['pii_kind'].upper()}]{text[s['stop'] :]}"
        out.append(text)
    return pd.Series(out)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): the text with every found entity replaced by its placeholder, all else unchanged; null stays null."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "pii_kind")).alias("_s"))
    put = F.pandas_udf(_replace, "string")
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", put("text", "_s").alias("text"))
