"""Personal information in free text by a semi-Markov conditional random field (problem 10).

A segment is a whole span with a type. Candidate segments are proposed wherever a text shows what
any such segment must have (digits in groups, an at-sign or its spelling, a listed name part, a
phrase that introduces a person, two capitalized words side by side, a street word); each is scored by features of the whole span and
its surroundings, and dynamic programming over segments of bounded length picks the best set of
non-overlapping ones. Everything outside a segment scores zero, so stretches without candidates
need no work and the decoding is exact over the whole text.

The weights are the maximum of the conditional likelihood over a bounded, documented set of generated
notes (``pii_training``); the given names and families come from the lexicon the caller passes, which
may be incomplete: a part that it does not list is judged by form and surroundings.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.runtime import bounded_rows

KINDS = ("name", "email", "phone", "idnum", "address")
FOUND = "doc_id bigint, pii_kind string, char_start bigint, char_end bigint, score double"

#: Words and phrases of the four languages the notes are written in.
TITLES = frozenset("mr mrs ms miss dr captain old young sir lady lord saint st madame monsieur mme frau herr señor señora don doña uncle aunt cousin doctor professor sergeant mister mistress father mother brother sister king queen widow master".split())
CUES = (
    "c/o", "signed,", "signed by", "yours,", "yours truly,", "sincerely,", "read by", "lent by", "belongs to", "bequeathed by", "given by", "donated by", "on behalf of", "name:", "card:",
    "volume to", "book to", "returned to", "the editor thanks", "thanks to", "au nom de", "prêté par", "prestado por", "gezeichnet", "zurück an", "exemplar von", "owner:", "property of", "gift of",
    "written by", "sent by", "addressed to", "contact", "i,", "firmado", "firmado por", "signé", "signé par", "geliehen von", "nombre:", "nom :", "nom:", "renvoyer à", "retourner à", "remettre à", "appartient à", "a nombre de", "pertenece a", "gehört", "dear", "regards,", "attn", "attention of", "the copy of",
)
SMALL = frozenset(
    "a an the and or of to in on at by for from with his her its my your our their he she it we they i you is was are were be been has had if when while that this these those who whom whose what which not no nor but as so then than there here please write ring call send return returned found dear yours signed name card "
    "le la les un une des du de et ou à au aux en dans par pour sur que qui ne pas plus tard soir der die das ein eine und oder von vom zu zum im am an auf den dem des kein keine am abend niemand später el los las una y o en con por para sin nadie later it "
    "passport address telephone tel corrections questions subscriber's reader's slip bitte anfragen preguntas joignable late before after chapter part page verse note "
    "captain".split()
)
#: Words that often stand capitalized beside another word and name no person.
COMMON = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "north south east west northern southern eastern western upper lower great little new grand royal holy red white black green blue golden silver high long big first second third last "
    "lake river sea ocean bay island isle mount mountain valley forest wood woods field fields bridge harbour harbor port hall house inn hotel tavern lion swan crown church chapel abbey cathedral castle tower market museum library school college university "
    "park point cape wind star sun moon city town village county kingdom empire republic state states north-east company society press book books volume part letter letters number day night morning evening spring summer autumn winter christmas easter god heaven love death time "
    "every some any all many much more most other another only even still never ever always again perhaps yes well oh ah now once just also such both few".split()
)
STREETS = frozenset("street st lane ln road rd terrace close row walk avenue ave drive way court square place hill gate mews crescent gardens alley boulevard quay wharf parade yard".split())
SHORT_STREETS = frozenset("st ln rd ave".split())
FRENCH = frozenset("rue avenue quai impasse place boulevard chemin allée allee ruelle passage cours route square".split())
SPANISH = frozenset("calle avenida plaza paseo camino carrera callejón".split())

L = r"[^\W\d_]"
WORD = rf"{L}+(?:['’-]{L}+)*"
GAP = r"(?:[^\S\n]+|[^\S\n]*\r?\n[^\S\n]*)"
TOKEN = re.compile(rf"{WORD}|\d+|[^\s\w]|_|(?P<par>\s*\n\s*\n\s*)", re.U)
AT = re.compile(r"\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s+at\s+", re.I)
HOST = re.compile(r"\w[\w-]*(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)\w[\w-]*)+", re.I)
DOT = re.compile(r"\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+", re.I)
DIGITS = re.compile(r"(?<![\w+])(?:\+\s?|\((?=\+?\d{1,5}\)))?\d+(?:(?:\)(?:[ –-]|[^\S\n]?\r?\n)?|[ .\/–‑-]|[^\S\n]?\r?\n|[ ]\(|(?<=\d)[ ]?\((?=0\)))\(?\d+)*(?!\w)")
CODE = re.compile(r"(?<![\w-])(?:[A-Za-z]{1,2}(?:[ -]|\r?\n)?\d{2}(?:(?:[ -]|\r?\n)?\d{2}){2}(?:[ -]|\r?\n)?[A-Za-z]|[A-Za-z]{1,3}-?\d{6,9}|[A-Za-z]{1,2}\d{2,4}(?:\.\d{2,5}){1,3})(?![\w])")
NUMBER = r"\d{1,4}(?:[^\S\n]?[a-z](?![\w]))?(?:[–/-]\d{1,4}[a-z]?)?"
STREET_AFTER = re.compile(
    rf"(?<![\w.–-])(?P<no>{NUMBER})(?P<sep>,?{GAP})(?:(?P<fr>(?:{'|'.join(sorted(FRENCH | SPANISH))}){GAP})|(?=(?:{L})))(?P<body>(?:{WORD}{GAP}?){{1,5}})", re.I | re.U
)
HOUSE = re.compile(r"(?<=\s)\d{1,4}[a-z]?(?!\w|\.\d)")
GERMAN = re.compile(r"(strasse|straße|gasse|weg|platz|allee|ufer|damm|ring|steig|markt)$")
PLACED = frozenset(("am", "im", "zum", "zur", "an der", "an den", "in der", "unter den", "auf der", "auf dem"))


def case_of(word: str) -> str:
    core = word.replace("-", "").replace("'", "").replace("’", "")
    return "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l"


def lowered(text: str) -> str:
    """Lower case of the same length, character by character where needed."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Lexicon:
    """Given names and families, and the automaton that finds them and the introducing phrases."""

    def __init__(self, given: list[str], family: list[str]):
        import ahocorasick

        self.given, self.family = frozenset(x.lower() for x in given if x), frozenset(x.lower() for x in family if x)
        self.automaton = ahocorasick.Automaton()
        for word in self.given | self.family:
            self.automaton.add_word(word, (len(word), True))
        for cue in CUES:
            if cue not in self.automaton:
                self.automaton.add_word(cue, (len(cue), False))
        self.automaton.make_automaton()

    def status(self, word: str) -> str:
        low = word.lower()
        if low in self.given:
            return "G"
        if low in self.family:
            return "F"
        if "-" in low:
            parts = low.split("-")
            if any(p in self.family for p in parts):
                return "F"
            if all(p in self.given for p in parts):
                return "G"
            return "H"
        return "s" if low in SMALL else "t" if low in TITLES else "c" if low in COMMON or low in STREETS else "?"


def around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Five tokens before and two after a span; a paragraph's edge counts as a token."""
    left = [("¶" if m["par"] else m.group().lower()) for m in TOKEN.finditer(text, max(0, start - 48), start)][-5:]
    if start - 48 <= 0:
        left = (["¶"] + left)[-5:]
    right = []
    for m in TOKEN.finditer(text, end, min(len(text), end + 30)):
        right.append("¶" if m["par"] else m.group().lower())
        if len(right) == 2:
            break
    return left, right


def _surroundings(kind: str, left: list[str], right: list[str]) -> list[str]:
    out = [f"{kind}:R1={right[0] if right else '¶'}"]
    for i, w in enumerate(reversed(left[-3:])):
        out.append(f"{kind}:L{i + 1}={w}")
    out.append(f"{kind}:L12={'_'.join(left[-2:])}")
    return out


def shape(span: str) -> str:
    return re.sub(r"\s+", "_", re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", span))).replace("–", "-").replace("‑", "-")


def _number_features(kind: str, span: str, left: list[str], right: list[str]) -> list[str]:
    digits = re.sub(r"\D", "", span)
    form = shape(span)
    groups = "-".join(str(len(g)) for g in re.findall(r"\d+", span))
    return [
        f"{kind}:bias", f"{kind}:shape={form}", f"{kind}:n={len(digits)}", f"{kind}:groups={groups}", f"{kind}:lead={'+' if span[0] == '+' else '(' if span[0] == '(' else '00' if digits[:2] == '00' else '0' if digits[:1] == '0' else '9' if span[0].isdigit() else 'A'}",
        f"{kind}:letters={form.count('A')}", f"{kind}:bag={'y' if any(w in ('isbn', 'issn', 'acc', 'shelf', 'mark', 'accession', 'lccn', 'inv', 'inventory') for w in left) else 'n'}",
        *(f"{kind}:near={w}" for w in set(left) if w.isalpha()), *_surroundings(kind, left, right),
    ]


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments (start, end, kind, features) of a text."""
    out: list[tuple[int, int, str, list[str]]] = []
    low = lowered(text)
    if "@" in low or " dot" in low or "\ndot" in low or "(at)" in low or "[at]" in low:
        for sign in AT.finditer(text):
            host = HOST.match(text, sign.end())
            start = sign.start()
            if not host or not start or not (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            while start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
                start -= 1
            end = host.end()
            at = "@" if "@" in sign.group() else "at" if sign.group().strip().lower() == "at" else "(at)"
            parts = DOT.split(host.group())
            spelled = "dot" in host.group().lower() and host.group().count(".") < len(parts) - 1
            left, right = around(text, start, end)
            out.append((start, end, "email", ["email:bias", f"email:at={at}", f"email:spelled={spelled}", f"email:{at}{spelled}", f"email:parts={len(parts)}", f"email:top={len(parts[-1])}", f"email:digits={parts[-1].isdigit()}", *_surroundings("email", left, right)]))
    if re.search(r"\d", low):
        for m in DIGITS.finditer(text):
            span = m.group()
            n = sum(c.isdigit() for c in span)
            if 7 <= n <= 15:
                end = m.end()
                left, right = around(text, m.start(), end)
                out.extend((m.start(), end, kind, _number_features(kind, span, left, right)) for kind in ("phone", "idnum"))
            elif n > 15:  # two numbers that stand side by side
                for cut in re.finditer(r"(?<=\d)[\s](?=[+(]?\d)", span):
                    for a, b in ((m.start(), m.start() + cut.start()), (m.start() + cut.end(), m.end())):
                        if 7 <= sum(c.isdigit() for c in text[a:b]) <= 15:
                            left, right = around(text, a, b)
                            out.extend((a, b, kind, _number_features(kind, text[a:b], left, right)) for kind in ("phone", "idnum"))
        for m in CODE.finditer(text):
            left, right = around(text, m.start(), m.end())
            out.append((m.start(), m.end(), "idnum", _number_features("idnum", m.group(), left, right)))
        for m in STREET_AFTER.finditer(text):
            body = [(w.group(), m.start("body") + w.end()) for w in re.finditer(WORD, m["body"])]
            if m["fr"]:
                if not body:
                    continue
                end = body[-1][1]
                for size in range(1, len(body) + 1):
                    w = body[size - 1][0]
                    if case_of(w) != "l" or size == len(body):
                        end = body[size - 1][1]
                        tail = body[size:size + 1]
                        if not (tail and case_of(tail[0][0]) != "l") and case_of(w) != "l":
                            break
                left, right = around(text, m.start(), end)
                out.append((m.start(), end, "address", ["address:bias", "address:form=number-rue", f"address:sep={m['sep'].strip()}", *_surroundings("address", left, right)]))
                continue
            for size in range(2, min(5, len(body)) + 1):
                if body[size - 1][0].lower() in STREETS:
                    end = body[size - 1][1]
                    end += text[end:end + 1] == "." and body[size - 1][0].lower() in SHORT_STREETS
                    left, right = around(text, m.start(), end)
                    no = m["no"]
                    year = no.isdigit() and len(no) == 4 and "1400" < no < "2100"
                    cases = "".join(sorted({case_of(w) for w, _ in body[:size]}))
                    out.append((m.start(), end, "address", ["address:bias", "address:form=number-street", f"address:year={year}", f"address:yearin={year and bool(left) and left[-1] in ('in', 'since', 'of', 'by', 'until')}", f"address:digits={len(re.match(r'[0-9]+', no).group())}", f"address:size={size}", f"address:case={cases}", f"address:small={any(w.lower() in SMALL for w, _ in body[:size - 1])}", f"address:sep={m['sep'].strip()}", *_surroundings("address", left, right)]))
                    break
        for m in HOUSE.finditer(text):
            for start, form in streets_before(text, m.start()):
                left, right = around(text, start, m.end())
                out.append((start, m.end(), "address", ["address:bias", "address:form=street-number", f"address:first={case_of(re.match(WORD, text[start:start + 40]).group())}", f"address:street={form}", *_surroundings("address", left, right)]))
    out.extend(name_candidates(text, low, lexicon))
    return out


def words_before(text: str, at: int, most: int, initials: bool = False) -> list[re.Match]:
    """Up to ``most`` words right before a place, nearest first, with nothing but a gap (and commas) in between.

    With ``initials``, a single letter and its point count as a word.
    """
    out: list[re.Match] = []
    point = None
    for m in reversed(list(TOKEN.finditer(text, max(0, at - max(70, 24 * most)), at))):
        word = m.group()
        if point is not None:
            if len(word) != 1 or not word.isalpha() or m.end() != point:
                break
            point = None
        elif initials and word == ".":
            point = m.start()
            continue
        elif m["par"] or not (word[0].isalpha() or word == ","):
            break
        out.append(m)
        if sum(x.group() != "," for x in out) == most:
            break
    return out


def streets_before(text: str, at: int) -> list[tuple[int, str]]:
    """(start, form) of street names that end right before a house number."""
    back = words_before(text, at, 5)
    comma = bool(back) and back[0].group() == ","
    words = [m for m in back if m.group() != ","]
    if not words or any(m.group() == "," for m in back[comma:][:1]):
        return []
    low = [m.group().lower() for m in words]
    out = []
    if not comma:
        kind = GERMAN.search(low[0])
        if kind and len(low[0]) > len(kind[1]) + 1:
            out.append((words[0].start(), kind[1]))
        elif kind and len(words) > 1:
            out.append((words[1].start(), "apart"))
        for size in (2, 3):
            if len(words) >= size and low[size - 1] in PLACED or len(words) > size and f"{low[size]} {low[size - 1]}" in PLACED:
                first = size - 1 if low[size - 1] in PLACED else size
                if case_of(words[0].group()) != "l" or text[words[first].start()].islower():
                    out.append((words[first].start(), "placed"))
    for size in range(1, len(words)):
        if low[size] in SPANISH:
            out.append((words[size].start(), "spanish"))
    return out


def name_candidates(text: str, low: str, lexicon: Lexicon) -> list[tuple[int, int, str, list[str]]]:
    starts: set[int] = set()
    introduced: set[int] = set()
    joined: set[int] = set()
    size = len(text)
    for last, (length, listed) in lexicon.automaton.iter(low.replace("\n", " ")):
        a, b = last + 1 - length, last + 1
        if a and low[a - 1].isalpha():
            continue
        if listed:
            if b < size and low[b].isalpha():
                continue
            lower = text[a].islower()
            while a and (text[a - 1] == "-" and a > 1 and text[a - 2].isalpha()):
                a -= 1
                while a and text[a - 1].isalpha():
                    a -= 1
            starts.add(a)
            for m in words_before(text, a, 2, initials=True):
                word = m.group()
                if word != "," and (lower or not word[0].islower()) and word.lower() not in TITLES:
                    starts.add(m.start())
        else:
            if b < size and low[b].isalpha() and low[b - 1].isalpha():
                continue
            m = _INTO.match(text, b)
            if m:
                starts.add(m.end())
                introduced.add(m.end())
    for start in introduced:  # a second person after the one a phrase introduces
        for span in _spans_at(text, start):
            m = _AND.match(text, span[1])
            if m:
                starts.add(m.end())
                joined.add(m.end())
    for m in _CAPITALIZED.finditer(text):  # capitalized words side by side that no list knows
        run = [(w.group(), m.start() + w.start()) for w in re.finditer(WORD, m.group())]
        open_word = [len(w) > 1 and w[0].isupper() and not w.isupper() and lexicon.status(w) in "?H" for w, _ in run]
        for k in range(len(run) - 1):
            if open_word[k] and (open_word[k + 1] or len(run[k + 1][0]) == 1):
                starts.add(run[k][1])
    out, seen = [], set()
    for start in sorted(starts):
        if start and (text[start - 1].isalnum() or text[start - 1] in "@._+"):
            continue
        for m in _spans_at(text, start):
            if (m[0], m[1], m[2]) in seen:
                continue
            seen.add((m[0], m[1], m[2]))
            a, b, form, parts = m
            cases = {case_of(p) for p in parts if len(p) > 2 or "." not in p}
            mixed = len(cases) > 1 and not (form[0] == "F" and cases == {"U", "T"})
            state = "".join(lexicon.status(p) if not p.endswith(".") else "i" for p in parts)
            if mixed and "l" in cases:
                continue
            if "G" not in state and "F" not in state and (cases == {"l"} and "s" in state):
                continue
            left, right = around(text, a, b)
            case = "m" if mixed else next(iter(cases), "T")
            known = ("G" in state) + ("F" in state)
            features = ["name:bias", f"name:form={form}", f"name:state={form}{state}", f"name:known={known}", f"name:case={case}", f"name:casestate={case}{known}", f"name:small={'s' in state}", f"name:title={'t' in state}", f"name:aftertitle={bool(left) and (left[-1] in TITLES or (left[-1] == '.' and len(left) > 1 and left[-2] in TITLES))}", f"name:n={len(parts)}"]
            tail = " ".join(left)
            cue = _ENDING.search(tail)
            features.append(f"name:cue={cue is not None}")
            features.append(f"name:joined={start in joined}{known}")
            features.append(f"name:cueknown={cue is not None}{known}")
            features.append(f"name:casecueknown={case}{cue is not None}{known}")
            if not known:
                follows = "_".join("9" if w.isdigit() else w if not w.isalpha() else "a" for w in right)
                features += [f"name:open={form}{state}{cue is not None}", f"name:opennext={follows}", f"name:openlast={'s' if left and left[-1] in SMALL else left[-1] if left and not left[-1].isalpha() else 'w'}"]
            features.extend(_surroundings("name", left, right))
            out.append((a, b, "name", features))
    return out


_ENDING = re.compile("(?:^| )(?:" + "|".join(re.escape(" ".join(m.group() for m in TOKEN.finditer(c))) for c in CUES) + ")$")
_PLAIN = re.compile(rf"({WORD})(?:{GAP}({WORD}|{L}\.))?(?:{GAP}({WORD}))?", re.U)
_UPPER = "[A-Z\u00C0-\u00D6\u00D8-\u00DE\u0100-\u024F\u0370-\u03AB\u0400-\u042F]"
_CAPITALIZED = re.compile(rf"(?<![\w@.'’-]){_UPPER}{L}+(?:[-'’]{L}+)*(?:{GAP}{_UPPER}(?:\.(?={GAP}{_UPPER})|{L}+(?:[-'’]{L}+)*))+", re.U)
_AND = re.compile(rf"{GAP}(?:and|und|et|y|&){GAP}(?={L})", re.U)
_INTO = re.compile(rf"{GAP}?(?={L})", re.U)
_INITIAL = re.compile(rf"({WORD}){GAP}({L}\.){GAP}({WORD})", re.U)
_COMMA_INITIAL = re.compile(rf"{WORD},{GAP}{WORD}{GAP}({L}\.)", re.U)
_COMMA = re.compile(rf"({WORD}),{GAP}({WORD})(?:{GAP}({L}\.|{WORD}))?", re.U)


def _spans_at(text: str, start: int) -> list[tuple[int, int, str, list[str]]]:
    """Name-shaped spans that begin at ``start``."""
    out = []
    m = _PLAIN.match(text, start)
    if m and m[2]:
        if len(m[2]) > 1 and not m[2].endswith("."):
            # a lone capital followed by a point belongs to an initial, not to a family
            if not (len(m[2]) == 1):
                out.append((start, m.end(2), "GF", [m[1], m[2]]))
            if m[3]:
                out.append((start, m.end(3), "GGF", [m[1], m[2], m[3]]))
        i = _INITIAL.match(text, start)
        if i:
            out.append((start, i.end(3), "GIF", [i[1], i[2], i[3]]))
    m = _COMMA.match(text, start)
    if m:
        out.append((start, m.end(2), "F,G", [m[1], m[2]]))
        i = _COMMA_INITIAL.match(text, start)
        if i:
            out.append((start, i.end(1), "F,GI", [m[1], m[2], i[1]]))
        elif m[3] and len(m[3]) > 1 and not m[3].endswith("."):
            out.append((start, m.end(3), "F,GG", [m[1], m[2], m[3]]))
    return out


class SemiMarkov:
    """A log-linear model over segmentations of candidate segments."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, segments: list[tuple[int, int, str, list[str]]]) -> list[tuple[int, int, str, float]]:
        """The best set of non-overlapping segments, exactly."""
        scored = sorted((end, start, kind, s) for start, end, kind, features in segments if (s := self.score(features)) > 0)
        if not scored:
            return []
        ends = [x[0] for x in scored]
        best, back = [0.0], [-1]
        for k, (end, start, kind, s) in enumerate(scored):
            j = bisect_right(ends, start, 0, k)
            with_it = best[j] + s
            if with_it > best[-1]:
                best.append(with_it)
                back.append(j)
            else:
                best.append(best[-1])
                back.append(-1)
        out, k = [], len(scored)
        while k:
            if back[k] >= 0:
                end, start, kind, s = scored[k - 1]
                out.append((start, end, kind, s))
                k = back[k]
            else:
                k -= 1
        return out[::-1]

    def expectations(self, segments: list) -> tuple[float, list[float]]:
        """Log partition function and the marginal probability of each candidate."""
        points = sorted({p for s in segments for p in s[:2]})
        at = {p: i for i, p in enumerate(points)}
        scores = [self.score(s[3]) for s in segments]
        by_end: list[list[int]] = [[] for _ in points]
        by_start: list[list[int]] = [[] for _ in points]
        for k, s in enumerate(segments):
            by_end[at[s[1]]].append(k)
            by_start[at[s[0]]].append(k)

        def add(a, b):
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        forward, backward = [0.0] * len(points), [0.0] * len(points)
        for i in range(len(points)):
            if i:
                forward[i] = forward[i - 1]
            for k in by_end[i]:
                forward[i] = add(forward[i], forward[at[segments[k][0]]] + scores[k])
        for i in range(len(points) - 1, -1, -1):
            if i + 1 < len(points):
                backward[i] = backward[i + 1]
            for k in by_start[i]:
                backward[i] = add(backward[i], backward[at[segments[k][1]]] + scores[k])
        total = forward[-1]
        return total, [math.exp(min(0.0, forward[at[s[0]]] + scores[k] + backward[at[s[1]]] - total)) for k, s in enumerate(segments)]

    @classmethod
    def fit(cls, sentences: list[tuple[list, set[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> SemiMarkov:
        """Maximum conditional likelihood by AdaGrad over (candidates, true segments)."""
        model, squares = cls({}), {}
        w = model.weights
        for _ in range(epochs):
            for segments, truth in sentences:
                if not segments:
                    continue
                _, chance = model.expectations(segments)
                for (start, end, kind, features), p in zip(segments, chance):
                    g = ((start, end, kind) in truth) - p
                    if abs(g) < 1e-4:
                        continue
                    for f in features:
                        d = g - decay * w.get(f, 0.0)
                        q = squares[f] = squares.get(f, 1e-8) + d * d
                        w[f] = w.get(f, 0.0) + rate * d / math.sqrt(q)
        return model


class Redactor:
    """Lexicon and model together."""

    def __init__(self, given: list[str], family: list[str], weights: dict[str, float]):
        self.lexicon, self.model = Lexicon(given, family), SemiMarkov(weights)

    def find(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) in code points, in order."""
        return self.model.decode(candidates(text, self.lexicon)) if text else []

    def redact(self, text: str | None) -> str | None:
        """The text with ``[KIND]`` in place of each segment and nothing else changed."""
        if not text:
            return text
        out, at = [], 0
        for start, end, kind, _ in self.find(text):
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*out, text[at:]])


def _lexicon_rows(lexicon: DataFrame, limit: int) -> tuple[list[str], list[str]]:
    rows = bounded_rows(lexicon.where("name_text is not null").selectExpr("trim(name_text) as name_text", "lower(trim(name_kind)) as name_kind").distinct(), limit, "the name lexicon")
    return sorted(r[0] for r in rows if r[1] == "given"), sorted(r[0] for r in rows if r[1] == "family")


def _run(documents: DataFrame, lexicon: DataFrame, schema: str, rows, max_names: int) -> DataFrame:
    from loomgraph.llm.pii_training import trained_weights

    given, family = _lexicon_rows(lexicon, max_names)
    shared = documents.sparkSession.sparkContext.broadcast((given, family, trained_weights()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor(*shared.value)
        for batch in batches:
            yield rows(redactor, batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return documents.select("doc_id", "text").mapInArrow(work, schema)


def _found(redactor: Redactor, ids: list, texts: list) -> pa.RecordBatch:
    rows = [(i, kind, a, b, s) for i, t in zip(ids, texts) for a, b, kind, s in redactor.find(t)]
    columns = list(zip(*rows)) or [[]] * 5
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "pii_kind", "char_start", "char_end", "score"])


def find_pii(documents: DataFrame, lexicon: DataFrame, max_names: int = 100_000) -> DataFrame:
    """(doc_id, pii_kind, char_start, char_end, score) of every segment; null and empty texts have none."""
    return _run(documents, lexicon, FOUND, _found, max_names)


def _redacted(redactor: Redactor, ids: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([redactor.redact(t) for t in texts], pa.string())], names=["doc_id", "text"])


def redact_documents(documents: DataFrame, lexicon: DataFrame, max_names: int = 100_000) -> DataFrame:
    """(doc_id, text) with typed placeholders; null stays null."""
    return _run(documents, lexicon, "doc_id bigint, text string", _redacted, max_names)
