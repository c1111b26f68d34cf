"""Freely written mentions to a canonical list (problem 4).

A multi-pattern automaton over the canonical names and their aliases runs over each mention once.
Both sides are written without marks, case, blanks and punctuation, so a name broken by a hyphen or
glued by an underscore is still found inside its mention; a match counts only where it begins and
ends with a word of the mention. The longest non-overlapping matches win. Mentions they leave open go
to token-set similarity: words within one edit of the list's words are read as those, and the entry
whose name part is named, and whose remaining words agree best, wins if no other does as well.

Aliases of an entry: its key, its words in the other order, and each name part that belongs to no
other entry. Titles, trades, things and small words are no name parts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import bounded_rows

NONE = "(none)"
#: The lowest share of an entry's words that a mention without an exact match must name.
LEAST = 0.5
#: Short forms of titles, titles, and words that never name anybody.
SHORT = {"st": "saint", "dr": "doctor", "mr": "mister", "capt": "captain", "cpt": "captain", "prof": "professor", "sgt": "sergeant", "mrs": "mistress", "ld": "lord", "yg": "young"}
TITLES = frozenset("aunt brother captain count countess cousin dame doctor duchess duke father grandfather grandmother judge king lady lord madam major master miss mister mistress mother old prince princess professor queen saint sergeant sir sister uncle widow young".split())
SMALL = frozenset("a an and as at before by dear for from her herself him himself his in it its my of on or our poor same s she tale that the their these this those to whole with".split())


def words(text: str | None) -> list[str]:
    """Words of a text without marks and case; possessive endings and short titles are resolved."""
    if not text:
        return []
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()
    plain = re.sub(r"['’‘`´ʼ]s(?![a-z0-9])", " ", re.sub(r"(?<=s)['’‘`´ʼ](?![a-z0-9])", " ", plain))
    plain = re.sub(r"['’‘`´ʼ]", "", plain)
    return [SHORT.get(w, w) for w in re.findall(r"[a-z0-9]+", plain)]


def within_one_edit(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart, or equal."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def folded(word: str) -> str:
    """A word with what scanners confuse written alike."""
    return word.replace("rn", "m").replace("0", "o").replace("1", "l").replace("5", "s")


class Matcher:
    """The automaton and the word index of one canonical list of (key, display name)."""

    def __init__(self, entries: list[tuple[str, str]], least: float = LEAST):
        import ahocorasick

        self.least = least
        self.forms: dict[str, list[str]] = {}
        for key, display in entries:
            written = [w for w in words(display or key) if w not in ("the", "a", "an")]
            self.forms[key] = written or words(key)
        owners: dict[str, set[str]] = defaultdict(set)
        for key, form in self.forms.items():
            for w in form:
                owners[w].add(key)
        self.owners = owners
        display_of = dict(entries)
        self.names: dict[str, set[str]] = {}
        for key, form in self.forms.items():
            plain = display_of.get(key) or key
            if "of" in form[1:-1]:  # trade of NAME
                parts = form[form.index("of") + 1:]
            elif re.search(r"['’‘`´ʼ]s?\s", plain):  # NAME's thing
                parts = form[:1]
            else:
                parts = [w for w in form if w not in TITLES]
            self.names[key] = {w for w in parts if w not in SMALL and len(w) > 2}
        self.parts: dict[str, set[str]] = defaultdict(set)
        for key, parts in self.names.items():
            for w in parts:
                self.parts[w] |= owners[w]
        automaton, patterns = ahocorasick.Automaton(), defaultdict(set)
        for key, form in self.forms.items():
            patterns["".join(form)].add(key)
            if len(form) == 2:
                patterns[form[1] + form[0]].add(key)
            for w in self.names[key]:
                patterns[w].update(self.parts[w])
        for pattern, keys in patterns.items():
            if pattern:
                automaton.add_word(pattern, (len(pattern), frozenset(keys)))
        self.empty = not len(automaton)
        automaton.make_automaton()
        self.automaton = automaton
        self.deletions: dict[str, set[str]] = defaultdict(set)
        for w in owners:
            if len(w) > 3:
                for form in {*self._shorter(folded(w)), *self._shorter(w)}:
                    self.deletions[form].add(w)

    @staticmethod
    def _shorter(word: str) -> list[str]:
        return [word, *(word[:i] + word[i + 1:] for i in range(len(word)))]

    def near(self, word: str) -> set[str]:
        """Words of the list within one edit of ``word`` (of four letters at least), confusions of a scanner aside."""
        if word in self.owners:
            return {word}
        if len(word) < 4:
            return set()
        plain = folded(word)
        found = set().union(*(self.deletions.get(form, ()) for form in {*self._shorter(plain), *self._shorter(word)}))
        same = {w for w in found if folded(w) == plain}
        return same or {w for w in found if within_one_edit(plain, folded(w)) or within_one_edit(word, w)}

    def embedded(self, tokens: list[str]) -> list[frozenset]:
        """Entry sets of the longest non-overlapping matches that begin and end at words."""
        if self.empty:
            return []
        starts, ends, at = set(), set(), 0
        for w in tokens:
            starts.add(at)
            at += len(w)
            ends.add(at)
        hits = []
        for last, (size, keys) in self.automaton.iter("".join(tokens)):
            if last + 1 in ends and last + 1 - size in starts:
                hits.append((size, last + 1 - size, keys))
        taken, out = [], []
        for size, start, keys in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(start + size <= a or start >= b for a, b in taken):
                taken.append((start, start + size))
                out.append(keys)
        return out

    def similar(self, tokens: list[str]) -> tuple[str, float]:
        """The entry most similar as a set of words, with its score, or (NONE, best score)."""
        joined = [a + b for a, b in zip(tokens, tokens[1:])]
        read = [self.near(w) for w in tokens]
        glued = [self.near(w) for w in joined]
        seen: set[str] = set().union(*read, *glued) if tokens else set()
        named = {k for w in seen if w in self.parts for k in self.parts[w] if w in self.names[k]}
        if not named:
            return NONE, 0.0
        ranked = []
        for key in named:
            form = [w for w in self.forms[key] if w != "of"]
            share = sum(w in seen for w in form) / len(set(form))
            exact = sum(w in tokens for w in form) / len(set(form))
            ranked.append((share, exact, key))
        ranked.sort(key=lambda r: (-r[0], -r[1], r[2]))
        if ranked[0][0] < self.least:
            return NONE, ranked[0][0]
        if len(ranked) > 1 and ranked[0][:2] == ranked[1][:2]:
            return NONE, ranked[0][0]
        best = ranked[0]
        shared = {k for w in seen if w in self.names[best[2]] for k in self.parts[w]}
        if len(shared) > 1 and best[0] < 1:  # an ambiguous name part needs its title
            return NONE, best[0]
        return best[2], best[0]

    def match(self, text: str | None) -> tuple[str, str, float]:
        """(entry key or NONE, method, score) of one mention."""
        tokens = words(text)
        if not tokens:
            return NONE, "empty", 0.0
        found = self.embedded(tokens)
        for keys in found:
            if len(keys) == 1:
                return next(iter(keys)), "automaton", 1.0
        key, score = self.similar(tokens)
        return key, "token_set" if key != NONE else "none", score


def map_mentions(mentions: DataFrame, entries: DataFrame, max_entries: int = 200_000, least: float = LEAST) -> DataFrame:
    """(row_index, mention_text, anchor_key, method, score), one row for each mention.

    The canonical list is a reference table: more than ``max_entries`` rows are refused. Entries
    without key are ignored. A mention without an exact match must name ``least`` of an entry's words,
    its distinctive part among them. Each distinct text is matched once. Null and blank texts name nothing;
    of rows repeating an index the greatest text counts; rows without index are ignored.
    """
    rows = bounded_rows(entries.where("anchor_key is not null").select("anchor_key", "display_name"), max_entries, "the canonical list")
    listed = sorted({(r["anchor_key"], r["display_name"]) for r in rows}, key=lambda e: (e[0], e[1] or ""))
    shared = mentions.sparkSession.sparkContext.broadcast(listed)

    @F.pandas_udf("anchor_key string, method string, score double")
    def matched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value, least)
        for texts in parts:
            yield pd.DataFrame([matcher.match(t) for t in texts], columns=["anchor_key", "method", "score"])

    single = mentions.where("row_index is not null").groupBy("row_index").agg(F.max("mention_text").alias("mention_text"))
    texts = single.select("mention_text").where("mention_text is not null").distinct().withColumn("m", matched("mention_text"))
    return single.join(texts, "mention_text", "left").select(
        "row_index", "mention_text", F.coalesce("m.anchor_key", F.lit(NONE)).alias("anchor_key"), F.coalesce("m.method", F.lit("empty")).alias("method"), F.coalesce("m.score", F.lit(0.0)).alias("score"),
    )
