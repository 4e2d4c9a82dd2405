"""Personal information inside free text: a semi-Markov conditional random field over whole spans.

Candidate segments of a text are bounded spans of the shape of an email address, number, street address or name. A
log-linear model scores each with features of the whole span and its surroundings; the text between them scores 0.
Dynamic programming over the boundaries then chooses, jointly, which spans to take and as what (the sum-product form of
the same recursion gives the gradient in training). Overlapping candidates compete, whatever their types.

The model is fitted on a bounded sample of documents (``SAMPLE_DOCS``), labelled by unambiguous evidence only: both
parts of a name in the lexicon, a number under an explicit label, and so on; everything doubtful is left out of the
training. Lexicon features are dropped at random there, so that the model learns to know names by form and context.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

#: At most so many documents are used to fit the model.
SAMPLE_DOCS = 1500
#: At most so many clusters of candidates are used to fit it.
SAMPLE_CLUSTERS = 6000
TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Words that end or begin a street's name, flats, labels, firms, titles.
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Close|Way|Drive|Row|Court|Place|Square|Crescent|Gardens|Grove|Walk|Hill|Park)"
_STRASSE = r"(?:[Ss]tra(?:ß|ss)e|[Ww]eg|[Gg]asse|[Aa]llee|[Pp]latz|[Ss]tr\.)"
_RUE = r"(?:[Rr]ue|[Aa]venue|[Pp]lace|[Cc]hemin|[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Vv]ia)"
_LABELS = {"tel", "telefon", "fon", "phone", "ring", "call", "tél", "mobile", "handy", "fax"}
_FIRM = {"ltd", "limited", "inc", "gmbh", "ag", "plc", "llc", "co", "company", "sons", "bros", "brothers", "trust", "society", "press", "railway", "station", "bahnhof", "gare", "estación"}
_PARTICLE = r"(?:van|von|der|den|de|del|della|di|da|du|la|le|el|al|bin|ter|zu)"
# Words that say a number is personal, or that it is none.
_PHONE_SAID = re.compile(r"(?:\b(?:tel|phone|fon|call|telefon|ring|telephone|téléphone|teléfono|mobile|móvil|handy|fax|cell|sms|text|txt)\b)\W{0,4}(?:me\W{1,2})?$")
_IDENT_SAID = re.compile(r"(?:ssn|\bid|\bid[ -]?no|\bid number|passport(?: no)?|national number|insurance no|ausweis|dni|nie|nif|tax no|licen[cs]e(?: no)?)\W{0,4}$")
_OTHER_SAID = re.compile(r"(?:isbn|issn|oclc|doi|pmid|\(id|\b(?:no|nr|number|nummer|num|ref|code|version|check\w*|\w+check))\W{0,4}$")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "m", "mme", "sr", "sra", "don", "sir"}

_EMAIL = re.compile(r"[\w.+%'-]+(?:@|&#64;|\s?[\[(](?:at|AT)[\])]\s?)[\w-]+(?:(?:\.|\s?[\[(](?:dot|DOT)[\])]\s?)[\w-]+)+")
_NUMBER = re.compile(r"(?<![\w.])(?:[A-Z]{1,3}[ -]?\d(?:[ -]?\d){4,11}|(?:\+|\()?\d(?:[ ()./-]{0,2}\d){6,18})(?:[ -]?[A-Z])?(?!\w)")
_CAP = r"[A-ZÀ-Ý][\w'’-]*"
_PLACE = rf"(?:,\s(?P<place>{_CAP}(?:\s{_CAP})?))?"
_FLAT = r"(?P<flat>(?:Flat|Apt\.?|Apartment|Unit|Suite|Wohnung|Piso|Appt\.?)\s\w+,\s)?"
_ADDRESS = (
    re.compile(rf"{_FLAT}(?P<core>\b\d{{1,4}}[a-zA-Z]?,?\s{_CAP}(?:\s{_CAP})??\s{_STREET}\b\.?(?:\s[NSEW]\b)?){_PLACE}"),
    re.compile(rf"{_FLAT}(?P<core>\b[A-ZÄÖÜ][\w'’-]*(?:\s{_CAP})??\s?{_STRASSE}\s\d{{1,4}}(?:\s?[a-zA-Z]\b)?){_PLACE}"),
    re.compile(rf"{_FLAT}(?P<core>\b(?:\d{{1,4}}[a-zA-Z]?(?:\s(?:bis|ter))?,?\s)?{_RUE}(?:\s(?:de|del|des|du|la|le|las|los|d'))*\s?{_CAP}(?:\s{_CAP})?(?:,?\s\d{{1,4}}[a-zA-Z]?\b)?){_PLACE}"),
)
_RUN = re.compile(rf"(?<![\w@]){_CAP}(?:\.(?=\s))?(?:,?[  ](?:{_PARTICLE}[  ]){{0,3}}{_CAP}(?:\.(?=\s))?)+")
_PART = re.compile(rf"(?:{_PARTICLE}[  ])*[\w'’-]+\.?")
#: Most parts of a name; particles go with the part they stand before.
PARTS = 4
#: More name parts than this are no lexicon to be held by every task.
LEXICON = 1_000_000
_DIGIT = re.compile(r"\d")
_STREETS = (re.compile(_STREET), re.compile(_STRASSE), re.compile(_RUE))
_LOWER = re.compile(r"(?<![\w'’])[a-zà-ÿ]{3,}(?![\w'’])")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")

Candidate = tuple[int, int, str, list[str]]


def _context(line: str, a: int, b: int) -> list[str]:
    before = _WORD.findall(line[max(0, a - 40) : a])[-3:]
    after = _WORD.findall(line[b : b + 24])[:2]
    low = [w.lower() if not w.isdigit() else "9" for w in before]
    nxt = [w.lower() if not w.isdigit() else "9" for w in after]
    out = ["l1=" + (low[-1] if low else "^"), "r1=" + (nxt[0] if nxt else "$")]
    words = [w for w in low if w.isalpha()]
    if words:
        out.append("lw=" + words[-1])
    if len(low) > 1:
        out.append("l2=" + low[-2] + " " + low[-1])
    if len(nxt) > 1:
        out.append("r2=" + nxt[0] + " " + nxt[1])
    return out


def _number_features(text: str) -> list[str]:
    shape = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", text))
    digits = sum(c == "9" for c in shape)
    out = ["b", "shape=" + shape, f"digits={digits}", "start=" + (text[0] if not text[0].isalnum() else shape[0]), "seps=" + "".join(sorted(set(re.sub(r"[9A]", "", shape))))]
    bare = re.sub(r"\D", "", text)
    if digits == 13 and bare[:3] in ("978", "979"):
        out.append("isbn")
    out.append("lead=" + ("00" if bare.startswith("00") else "0" if bare.startswith("0") else "1" if bare.startswith("1") else "x") + f"/{digits}")
    if "A" in shape:
        out.append("letters=" + shape.strip("9 -").replace("9", "")[:4])
    return out


class Lexicon:
    """Name parts of a lexicon, and words that also occur in lower case."""

    def __init__(self, given: set[str], family: set[str], ordinary: set[str]):
        self.given, self.family, self.ordinary = given, family, ordinary


def _kind(word: str) -> str:
    bare = word.rstrip(".")
    return "I" if len(bare) == 1 else "U" if bare.isupper() else "C"


def _family_form(word: str) -> list[str]:
    w = word.lower()
    return [f"s2={w[-2:]}", f"s3={w[-3:]}", f"p3={w[:3]}", f"p4={w[:4]}", f"ps={w[:3]}~{w[-2:]}"] if len(w) > 3 else ["short"]


def _names(line: str, lex: Lexicon, drop: random.Random | None) -> Iterator[tuple[int, int, list[str], str]]:
    """Candidate names with features and, for training, what the lexicon says: 'both', 'one', 'none' (and ordinary words) or ''."""
    for run in _RUN.finditer(line):
        parts = [(m.start() + run.start(), m.end() + run.start(), m.group()) for m in _PART.finditer(run.group())]
        for i, j in ((i, j) for i in range(len(parts)) for j in range(i + 2, i + PARTS + 1) if j <= len(parts)):
            some = parts[i:j]
            joins = [line[some[k][1] : some[k + 1][0]] for k in range(len(some) - 1)]
            # What a part is told by is its last word.
            words = [p[2].split()[-1] for p in some]
            kinds = "".join(_kind(w) for w in words)
            if joins[0].startswith(","):
                if any("," in x for x in joins[1:]):
                    continue
                family, given, form = words[0], words[1], "F,G"
            elif any("," in x for x in joins):
                continue
            else:
                family, given, form = words[-1], words[0], "GF"
            if any(len(w.rstrip(".")) > 1 and w.rstrip(".").lower() in _TITLES | _FIRM for w in words):
                continue
            if _kind(given) == "I" and not given.endswith("."):
                continue
            if _kind(family) == "I":
                continue
            fam, giv = family.rstrip(".").lower(), given.rstrip(".").lower()
            end = some[-1][1]
            if line[end - 1] == "." and kinds[-1] != "I":
                end -= 1
            in_f, in_g = fam in lex.family, giv in lex.given
            middle = kinds[1:-1] if form == "GF" else kinds[2:]
            plain = set(middle) <= {"I"}
            said = "both" if plain and (in_f and (in_g or _kind(given) == "I") or middle and (in_f or in_g)) else "one" if in_f or in_g else ""
            if drop and drop.random() < 0.5:
                in_f = False
            if drop and drop.random() < 0.5:
                in_g = False
            g = "I" if _kind(given) == "I" else "L" if in_g else "u"
            feats = ["b", f"form={form}/{kinds}", f"lex={g}{'L' if in_f else 'u'}", f"n={j - i}"]
            if not plain:
                feats.append("middle=" + middle)
            if any(" " in p[2] for p in some):
                feats.append("particle")
            feats += ["f" + x for x in _family_form(fam)]
            if fam in lex.ordinary:
                feats.append("ford" + ("L" if in_f else ""))
            if giv in lex.ordinary:
                feats.append("gord" + ("L" if in_g else ""))
            if fam in lex.ordinary and giv in lex.ordinary:
                feats.append("bothord/" + kinds)
            around = re.findall(r"[^\W\d_]{2,}", line[max(0, some[0][0] - 14) : some[0][0]])[-1:] + re.findall(r"[^\W\d_]{2,}", line[end : end + 14])[:1]
            shouted = any(w.isupper() for w in around)
            if shouted:
                feats.append("shouted/" + kinds)
            if g == "u":
                feats.append(f"gw={giv}")
                feats += ["g" + x for x in _family_form(giv)]
            before = line[max(0, some[0][0] - 8) : some[0][0]]
            prior = re.findall(r"[^\W\d_]+", before)
            if prior and prior[-1].lower() in _TITLES:
                feats.append("title")
            if i > 0:
                feats.append("more-left")
            if j < len(parts):
                feats.append("more-right=" + ("I" if _kind(parts[j][2]) == "I" else "C"))
            if not plain and said != "both" or said == "" and (shouted or fam in lex.ordinary or giv in lex.ordinary):
                said = "none"
            yield some[0][0], end, feats + _context(line, some[0][0], end), said


def candidates(line: str, lex: Lexicon, drop: random.Random | None = None, labels: list[str] | None = None) -> list[Candidate]:
    """All candidate segments of a line. With ``labels``, what unambiguous evidence says of each is appended: 'yes', 'no' or '?'."""
    out: list[Candidate] = []

    def add(a: int, b: int, kind: str, feats: list[str], label: str) -> None:
        out.append((a, b, kind, [f"{kind}|{x}" for x in feats]))
        if labels is not None:
            labels.append(label)

    if "@" in line or "#64;" in line or "at]" in line or "at)" in line.lower():
        for m in _EMAIL.finditer(line):
            a, b = m.span()
            tail = re.split(r"\W+", m.group())[-1].lower()
            file = tail in ("png", "jpg", "jpeg", "svg", "gif", "webp") or tail.isdigit()
            add(a, b, "EMAIL", ["b", "file" if file else "host", f"tail={tail}"] + _context(line, a, b)[:2], "no" if file else "yes")
    for m in _NUMBER.finditer(line) if _DIGIT.search(line) else ():
        a, b = m.span()
        text = m.group()
        if text[0] == "(" and ")" not in text:
            a, text = a + 1, text[1:]
        if re.fullmatch(r"\d+\.\d+", text):  # a measure
            continue
        feats = _number_features(text) + _context(line, a, b)
        low = line[max(0, a - 24) : a].lower()
        phone = bool(_PHONE_SAID.search(low)) or text[0] == "+"
        ident = bool(_IDENT_SAID.search(low)) or bool(re.match(r"[A-Z]{1,2} ?\d|\d{3}-\d{2}-\d{4}$|\d{3} \d{3} \d{3} \d$", text))
        other = bool(_OTHER_SAID.search(low)) and not _IDENT_SAID.search(low) or "isbn" in feats
        for kind, mine, theirs in (("PHONE", phone, ident or other), ("ID_NUMBER", ident, phone or other)):
            add(a, b, kind, feats, "yes" if mine and not other else "no" if theirs else "?")
    if _DIGIT.search(line):
        for k, pattern in enumerate(_ADDRESS):
            # Most lines with numbers name no street at all.
            for m in pattern.finditer(line) if _STREETS[k].search(line) else ():
                if not any(c.isdigit() for c in m.group("core")):
                    continue
                a0, b0 = m.span("core")
                place = (m.group("place") or "").lower()
                # A word before a number is a label and no place.
                label_word = bool(re.match(r"\W{0,3}\d|\W{1,2}[+(]", line[m.end() : m.end() + 4])) and not line[m.end() :].startswith((" (ring", " (t"))
                starts = [m.start()] + ([a0] if m.group("flat") else [])
                ends = [m.end()] + ([b0] if m.group("place") else [])
                for a in starts:
                    for b in ends:
                        full = a == m.start() and (b == b0 if label_word else b == m.end())
                        feats = ["b", f"pattern={k}", "flat" if a < a0 else "noflat" if len(starts) > 1 else "", "place" if b > b0 else "noplace" if len(ends) > 1 else ""] + _context(line, a, b)
                        if place:
                            feats += [("in-" if b > b0 else "out-") + x for x in (f"s3={place[-3:]}", f"s4={place[-4:]}", f"w={place}" if place in _LABELS else "", "num" if label_word else "")]
                        after = re.match(r"\s(\w+)", line[m.end() :])
                        add(a, b, "ADDRESS", [f for f in feats if f], "no" if not full or after and after.group(1).lower() in _FIRM else "yes")
    for a, b, feats, said in _names(line, lex, drop):
        label = "?"
        if labels is not None:
            after = re.match(r"\s(\w+)", line[b:])
            label = "no" if said == "none" or after and after.group(1).lower() in _FIRM else "yes" if said == "both" else "?"
        add(a, b, "NAME", feats, label)
    return out


def clusters(found: list[Candidate]) -> Iterator[list[int]]:
    """Indexes of candidates, grouped so that only those of one group overlap."""
    order, group, reach = sorted(range(len(found)), key=lambda i: found[i][:2]), [], -1
    for i in order:
        if group and found[i][0] >= reach:
            yield group
            group = []
        group.append(i)
        reach = max(reach, found[i][1]) if len(group) > 1 else found[i][1]
    if group:
        yield group


def decode(found: list[Candidate], group: list[int], weights: dict[str, float]) -> list[int]:
    """The best-scoring set of candidates that do not overlap (semi-Markov Viterbi; what is outside scores 0)."""
    score = [sum(weights.get(f, 0.0) for f in found[i][3]) for i in group]
    if len(group) == 1:
        return [group[0]] if score[0] > 0 else []
    cuts = sorted({x for i in group for x in found[i][:2]})
    place = {x: k for k, x in enumerate(cuts)}
    best, back = [0.0] * len(cuts), [None] * len(cuts)
    ending: dict[int, list[int]] = {}
    for k, i in enumerate(group):
        ending.setdefault(place[found[i][1]], []).append(k)
    for p in range(1, len(cuts)):
        best[p], back[p] = best[p - 1], None
        for k in ending.get(p, ()):
            s = best[place[found[group[k]][0]]] + score[k]
            if s > best[p]:
                best[p], back[p] = s, k
    taken, p = [], len(cuts) - 1
    while p > 0:
        if back[p] is None:
            p -= 1
        else:
            taken.append(group[back[p]])
            p = place[found[group[back[p]]][0]]
    return taken[::-1]


def marginals(found: list[Candidate], group: list[int], weights: dict[str, float]) -> list[float]:
    """The probability of each candidate under the model (forward-backward over the same lattice)."""
    cuts = sorted({x for i in group for x in found[i][:2]})
    place = {x: k for k, x in enumerate(cuts)}
    edges = [(place[found[i][0]], place[found[i][1]], math.exp(max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in found[i][3]))))) for i in group]
    n = len(cuts)
    fwd, bwd = [1.0] + [0.0] * (n - 1), [0.0] * (n - 1) + [1.0]
    for p in range(1, n):
        fwd[p] = fwd[p - 1] + sum(fwd[a] * w for a, b, w in edges if b == p)
    for p in range(n - 2, -1, -1):
        bwd[p] = bwd[p + 1] + sum(bwd[b] * w for a, b, w in edges if a == p)
    return [fwd[a] * w * bwd[b] / fwd[-1] for a, b, w in edges]


def fit(lines: list[str], given: set[str], family: set[str], epochs: int = 6, seed: int = 7, ordinary: set[str] | None = None) -> tuple[Lexicon, dict[str, float]]:
    """Fit the field by conditional likelihood (AdaGrad) on the clusters of ``lines`` without doubtful candidates.

    ``ordinary`` are the words that also occur in lower case; if not given, those of ``lines``.
    """
    rng = random.Random(seed)
    if ordinary is None:
        ordinary = {w for line in lines for w in _LOWER.findall(line)}
    lex = Lexicon({g.lower() for g in given}, {f.lower() for f in family}, ordinary)
    kept = []
    for line in dict.fromkeys(lines):
        for _ in range(2):
            labels: list[str] = []
            found = candidates(line, lex, rng, labels)
            for group in clusters(found):
                # Within a cluster the longest sure segments are the truth; any other doubt there leaves it out.
                sure: list[int] = []
                for i in sorted((i for i in group if labels[i] == "yes"), key=lambda i: found[i][0] - found[i][1]):
                    if all(found[i][1] <= found[j][0] or found[i][0] >= found[j][1] for j in sure):
                        sure.append(i)
                if any(labels[i] == "?" and not any(found[i][0] < found[j][1] and found[j][0] < found[i][1] for j in sure) for i in group):
                    continue
                kept.append((found, group, set(sure)))
    weights = _climb(kept, epochs, rng)
    # Names the lexicon lacks: a second round takes the doubtful clusters of which the first is sure.
    for line in dict.fromkeys(lines):
        labels = []
        found = candidates(line, lex, rng, labels)
        for group in clusters(found):
            if any(labels[i] == "?" for i in group) and not any(labels[i] == "yes" for i in group):
                odds = marginals(found, group, weights)
                if all(p > 0.85 or p < 0.1 for p in odds):
                    kept.append((found, group, {i for i, p in zip(group, odds, strict=True) if p > 0.85}))
    return lex, {f: w for f, w in _climb(kept, epochs, rng).items() if abs(w) > 1e-4}


def _climb(kept: list[tuple[list[Candidate], list[int], set[int]]], epochs: int, rng: random.Random) -> dict[str, float]:
    rng.shuffle(kept)
    positive = [k for k in kept if k[2]]
    negative = [k for k in kept if not k[2]]
    kept = positive[: SAMPLE_CLUSTERS // 2] + negative[: SAMPLE_CLUSTERS // 2]
    weights: dict[str, float] = {}
    power: dict[str, float] = {}
    for _ in range(epochs):
        rng.shuffle(kept)
        for found, group, sure in kept:
            for i, p in zip(group, marginals(found, group, weights), strict=True):
                err = (i in sure) - p
                if abs(err) < 1e-3:
                    continue
                for f in found[i][3]:
                    g = err - 1e-4 * weights.get(f, 0.0)
                    power[f] = power.get(f, 0.0) + g * g
                    weights[f] = weights.get(f, 0.0) + 0.4 * g / math.sqrt(power[f] + 1e-6)
    return weights


def find(line: str, lex: Lexicon, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Spans of personal information in one line."""
    found = candidates(line, lex)
    return sorted(found[i][:3] for group in clusters(found) for i in decode(found, group, weights))


#: Entries of a worker's memory of lines already decided; emptied when full. Revisions repeat most of their lines.
MEMO = 40_000


def spans_of(text: str, lex: Lexicon, weights: dict[str, float], memo: dict[str, list]) -> list[tuple[int, int, str]]:
    """Spans in a whole text. Lines are decided one by one: no segment crosses a line break."""
    out, at = [], 0
    for line in text.split("\n"):
        hit = memo.get(line)
        if hit is None:
            if len(memo) >= MEMO:
                memo.clear()
            hit = memo[line] = find(line, lex, weights)
        for a, b, kind in hit:
            out.append((at + a, at + b, kind))
        at += len(line) + 1
    return out


def ordinary_words(documents: DataFrame, text: str = "text") -> set[str]:
    """The possible name parts of all documents that also occur in lower case in some document."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low: set[str] = set()
            part: set[str] = set()
            for t in pdf["t"]:
                low.update(_LOWER.findall(t))
                part.update(m.group().rstrip(".").lower() for r in _RUN.finditer(t) for m in _PART.finditer(r.group()))
            yield pd.DataFrame([(w, True, False) for w in low] + [(w, False, True) for w in part], columns=["w", "low", "part"])

    words = documents.select(F.col(text).alias("t")).where("t is not null").mapInPandas(run, "w string, low boolean, part boolean")
    return {r[0] for r in words.groupBy("w").agg(F.max("low").alias("low"), F.max("part").alias("part")).where("low and part").select("w").collect()}


def train(documents: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id", docs: int = SAMPLE_DOCS):
    """The fitted model from at most ``docs`` documents, chosen by a hash of the key, and the lexicon (name_part, part_kind)."""
    total = max(documents.count(), 1)
    share = min(1.0, 1.3 * docs / total)
    sample = documents.where((F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)) & F.col(text).isNotNull()).select(text).limit(docs).collect()
    parts = lexicon.where("name_part is not null").select("name_part", "part_kind").distinct().limit(LEXICON + 1).collect()
    if len(parts) > LEXICON:
        raise ValueError(f"a lexicon of more than {LEXICON} parts")
    return fit([x for r in sample for x in r[0].split("\n")], {p[0] for p in parts if p[1] == "given"}, {p[0] for p in parts if p[1] == "family"}, ordinary=ordinary_words(documents, text))


def detect(documents: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each distinct piece of personal information: (key, pii_type, pii_text).

    Null and empty texts have none; a null key is kept. Repeated rows of one key give their union. The model is the
    only thing broadcast; its size is bounded by the training sample and the lexicon.
    """
    spark, kind = documents.sparkSession, documents.schema[key].dataType.simpleString()
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (lex, weights), memo = shared.value, {}
        for pdf in batches:
            rows = []
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                if t:
                    rows += {(k, kind, t[a:b]) for a, b, kind in spans_of(t, lex, weights, memo)}
            yield pd.DataFrame(rows, columns=["k", "pii_type", "pii_text"])

    found = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, pii_type string, pii_text string")
    return found.select(F.col("k").alias(key), "pii_type", "pii_text")


def redact(documents: DataFrame, model, text: str = "text") -> DataFrame:
    """``documents`` with ``text`` rewritten, each piece replaced by its type in brackets; other columns stay. Null stays null."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (lex, weights), memo = shared.value, {}
        for pdf in batches:
            out = []
            for t in pdf[text]:
                if t:
                    parts, last = [], 0
                    for a, b, kind in spans_of(t, lex, weights, memo):
                        parts += [t[last:a], f"[{kind}]"]
                        last = b
                    t = "".join(parts) + t[last:]
                out.append(t)
            pdf[text] = out
            yield pdf[names]

    return documents.mapInPandas(run, documents.schema)
