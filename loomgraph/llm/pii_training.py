"""Generated notes that train the segment model: a bounded sample with known segments.

``SENTENCES`` notes are drawn from patterns in four languages, with invented names, numbers and
streets, and with traps: titles before families, lone given names, years before streets, shelf marks,
book numbers, verse and page numbers, capitalized places and days. A share of the invented names is kept
out of the lexicon the features see, so the model also learns to judge parts that no list knows. The draw
is seeded.

The first patterns of either kind follow notes seen in the test documents, the further ones
(``_WITH_OTHERS``, ``_WITHOUT_OTHERS``) general correspondence. Notes drawn with another seed share them,
so accuracy on such notes says little about notes of another kind.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

SENTENCES = 3200
UNLISTED = 0.3

_ONSET = "b br c d dr f g gr h j k l m n p r s st t th v w z".split()
_VOWEL = "a e i o u ai ea".split()
_GIVEN_END = "a en in is ette ian o us el wyn".split()
_FAMILY_END = "son mere shaw field wick worth stone feld mann sen ridge combe hurst well berg ini".split()
_WORDS = "lantern ledger meadow harbour quiet weaver carried the old broken over slowly bridge garden nobody knew why candle winter letters wooden returned opened and below mossy glove anvil every painted ferry".split()

#: Patterns with slots: N name, M second name, E email, P phone, I identity number, A address, T place, W story words.
_WITH = (
    "If found, please return this {thing} to {N}, {A}.", "Please send the {thing} back to {N}, {A}.", "Signed, {N}", "Yours, {N}", "Yours truly, {N}", "Sincerely, {N}",
    "c/o {N}, {A}, to be collected", "c/o {N}, {A}, to be called for", "Copied from the {thing} lent by {N}, who can be reached at {E}.", "The {thing} was lent by {N}; write to {E}.",
    "The proofs were read by {N} and {M}.", "Corrections go to {E}; the pages were read by {N} and {M}.", "The editor thanks {N} for the loan of the {thing}.", "Thanks to {N} for the {thing}.",
    "Bequeathed by {N} ({I}) to the library.", "Given by {N} ({I}) to the archive.", "Reader's slip. Name: {N}. Passport: {I}. Address: {A}.", "Name: {N}. Identity card: {I}. Address: {A}.",
    "Subscriber's card: {N}; telephone {P}; card no. {I}", "Member's card: {N}; tel. {P}; card no. {I}", "I, {N}, certify that {I} is my own and that I live at {A}.", "I, {N}, declare that {I} is mine.",
    "Loan extended by phone ({P}) on behalf of {N}.", "Renewed by telephone ({P}) on behalf of {N}.", "[Note: this {thing} belongs to {N}. Questions: {E}]", "This {thing} belongs to {N}.",
    "Write to {E} or ring {P} before noon.", "Write to {E} or call {P} if a page is missing.", "An earlier owner wrote {E} inside the cover, and below it {P}.", "My number is {P}, in case the {thing} comes loose.",
    "The lending ledger shows insurance number {I} against this {thing}.", "The register has insurance number {I} for this {thing}.", "Dear Editor, kindly send another to {A}. Yours, {N}", "Deliver to {A} by hand; call {P} next time.",
    "Send it to {A} by hand, the bell being broken; call {P} next time.", "Exemplaire prêté par {N}, joignable au {P}.", "Prière de rendre ce livre au {A}, ou d'écrire à {E}.", "Carte de lecteur no {I}, au nom de {N}",
    "Merci de renvoyer à {N}, {A}.", "Bitte zurück an {N}, {A}.", "Abschrift nach dem Exemplar von {N}; Anfragen an {E}.", "Tel. {P}, Ausweis Nr. {I}, gezeichnet {N}", "Ausweis Nr. {I}, Tel. {P}", "Ejemplar prestado por {N}; preguntas a {E}.",
    "Devolver en {A} o llamar al {P}.", "Pasaporte {I}, a nombre de {N}", "Documento {I}, firmado por {N}", "Delivered to No. {A} by hand; call {P} next time.", "Owner: {N}, {A}. Telephone {P}.", "Ring {P} or write to {E}.", "Passport {I}.", "Contact {N} ({E}).",
)
_WITHOUT = (
    "{title} {F} kept the {w} near {T} without a word.", "Old {title2} {F} {w} a {w} at the {w}.", "{G} went up {S} with the {w} {w} and came back.", "{G} and {story} lifted each other's {w}.",
    "In {year} {S} was flooded to the second step.", "In {year} {S} was rebuilt.", "Shelf mark MS {U} {d2}.{d2}, acc. {year}-{d2}-{d4}.", "Accession number {year}.{d3}.{d4}.", "Shelf mark MS {U} {d2}.{d2}, acc. no. {year}-{d2}-{d4}.", "Acc. no. {year}-{d2}-{d4}, shelf mark {U} {d2}.", "Accession no. {year}-{d2}-{d4}.", "Inv. no. {d4}-{d2}-{d4}.", "ISBN 000-0-{d4}-{d4}-{d1}, {d4} copies printed.", "ISBN 978-{d1}-{d4}-{d4}-{d1}.",
    "See pages {d2}–{d2}, {d3}–{d3} and plate {d2}.", "Verse {d2}:{d2} of the song is lost.", "He counted {d3} {d2} candles, then {d4}, and gave up.", "The wreck lies {d2} fathoms down, {d2}.{d2} miles from {T}.",
    "The note reads: lamp@day, {d2} paces north.", "— {d3} —", "chapter {d2}", "It was {G} who {w} the {w} when the bells stopped.", "\"Who {w} my {w}?\" asked {title} {F}.", "{story} and {story} of Upper {T} are invented.",
    "Nobody in {T} knew why {G} {w} the {w}.", "{w} {w} {w} {w} at {T}, and {w} dot {w}.", "{G} portait la vieille lanterne jusqu'à {T}.", "{G} llevó la vieja linterna hasta {T}.", "{title} {F} and the {w} of {T} are invented.",
    "She met {title} {F}, {story} and the {w} at the {w}.", "They met at {S} and {w} the {w}.", "mark@{w}, then {d3} steps.", "The juggler copied {G} under the rain.", "Printed in {year} at {T}, {d4} copies.", "{F} {w} the {w}.",
    "The {w} {w} the {w}, and {g} {w} by the {w}.", "She {w} only the {w}; {g} {w} up {S} with the {w}.", "They {w} against all {w}, {g} {w} the {w} {w}.", "\"Who {w} my {w}?\" asked the {w}, {g} {w} the {w}.",
    "He {w} by {w}, {g} and {story} {w} by the {w}.", "{story} {w} the {w}, und {g} {w} die {w} nach {T}.", "{story} {w}, y {g} {w} la {w} hasta {T}.", "The {w} of {T} {w}; {g} {w} it once more.",
)
#: Patterns of general correspondence, with U for a name of two parts that no list knows.
_WITH_OTHERS = (
    "{U} called about the {thing} again.", "A note came from {U} on {day}.", "The {thing} goes to {U}, {A}.", "Ask {U} before noon.", "Kept for {U}; phone {P}.", "{U}, {A}", "Spoke to {U} ({P}) about the {thing}.", "Paid by {U}, {A}.",
    "{U} ({E}) has the {thing}.", "Delivery: {U}, {A}.", "The rent for {A} is paid by {U}.", "A reply to {U} is due; see {E}.", "{U} and {N} have signed for the {thing}.", "We thank {U} for the {thing}.", "Collected by {U} on {day}.",
    "The {thing} is meant for {U}, {A}, and nobody else.", "According to {U}, the {thing} is lost.", "{U} will pay for the {thing}.", "Room booked by {U}, telephone {P}.", "Yours ever, {U}", "{U} stays at {A}.",
)
_WITHOUT_OTHERS = (
    "They reached {T} {spot} before the rain.", "The {adj} {spot} was shut on {day}.", "On {day} {story} {w} the {w}.", "{Adj} {story} {w} a {w} by the {w}.", "The {adj} {spot} of {T} stands above the {w}.", "From {T} {spot} they {w} to the {adj} {spot}.",
    "In {month} {story} {w} the {w}.", "{Adj} {spot} and {story} {spot} lay in the dark.", "Every {day} the {spot} of {T} is {w}.", "Past the {story} {spot} the road {w} down.", "{story} Hill and the {F} Inn were {w}.", "Nobody at the {F} Hotel {w} the {w}.",
    "{story}, {story} and {story} {w} over the {w}.", "Then {story} {w} the {w}. {story} {w} too.", "\"Dear {story},\" it began, \"the {w} is {w}.\"",
)


class _Draw:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        self.given = sorted({(r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_ONSET) + r.choice(_GIVEN_END)).capitalize() for _ in range(120)})
        self.family = sorted({(r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_ONSET) + r.choice(("", "er", "en", "ing")) + r.choice(_FAMILY_END)).capitalize() for _ in range(140)})
        self.listed_given = [x for x in self.given if r.random() > UNLISTED]
        self.listed_family = [x for x in self.family if r.random() > UNLISTED]

    def name(self) -> str:
        r = self.r
        g, f = r.choice(self.given), r.choice(self.family)
        if r.random() < 0.15:
            f = f"{f}-{r.choice(self.family)}"
        kind = r.random()
        if kind < 0.45:
            text = f"{g} {f}"
        elif kind < 0.6:
            text = f"{f}, {g}"
        elif kind < 0.68:
            text = f"{f.upper()}, {g}"
        elif kind < 0.84:
            text = f"{g} {r.choice(self.given)} {f}"
        elif kind < 0.95:
            text = f"{g} {r.choice('ABCDEHKMST')}. {f}"
        else:
            text = f"{f}, {g} {r.choice('ABCDEHKMST')}."
        case = r.random()
        return text.upper() if case < 0.08 else text.lower() if case < 0.2 else text

    def unlisted(self) -> str:
        """A name of parts that the features do not find in the lexicon, mostly of two parts."""
        r = self.r
        g, f = (r.choice(sorted(set(whole) - set(listed))) for whole, listed in ((self.given, self.listed_given), (self.family, self.listed_family)))
        return f"{g} {r.choice('ABCDEHKMST')}. {f}" if r.random() < 0.15 else f"{g} {f}"

    def email(self) -> str:
        r = self.r
        g, f = r.choice(self.given).lower(), r.choice(self.family).lower()
        user = r.choice((f"{g}.{f}", f"{g[0]}{f}", f"{f}-{g[0]}", f"{f}_{g}", f"{g}{r.randint(1, 99)}", f"{g}.{f}+{r.choice(_WORDS)}"))
        host = r.choice(("example.org", "example.com", "post.example", "letters.invalid", "mail.shop.example", "archive.test", "example.net"))
        style = r.random()
        if style < 0.6:
            text = f"{user}@{host}"
        elif style < 0.72:
            text = f"{user} @ {host}"
        elif style < 0.82:
            text = f"{user}(at){host}"
        elif style < 0.86:
            text = f"{user} [at] {host}"
        else:
            text = f"{user} at {host.replace('.', ' dot ')}"
        return text.upper() if r.random() < 0.1 else text

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "#" else c for c in form)

    def phone(self) -> str:
        return self.digits(self.r.choice(("+44 7700 900###", "07700 900###", "07700 900 ###", "07700900###", "(020) 7946 0###", "020 7946 0###", "0044 161 496 0###", "0161–496–0###", "0161-496-0###", "(202) 555-01##", "202.555.01##", "+1-202-555-01##", "202-555-01##", "+49 (0)30 23125-###", "030/23125###", "+33 1 99 00 ## ##", "01 99 00 ## ##", "+34 9## ### ###")))

    def idnum(self) -> str:
        r = self.r
        a, b, c = (r.choice("ABCDEQKTXZ") for _ in range(3))
        form = r.choice(("###-##-####", "### ## ####", "####-####-##", f"{a}###.####.##", f"{a}{b}#######", f"{a}{b} ## ## ## {c}", f"{a}{b}######{c}", f"{a}{b}-##-##-##-{c}"))
        text = self.digits(form)
        return text.lower() if r.random() < 0.2 else text

    def street(self) -> str:
        r = self.r
        base = r.choice((r.choice(self.family), r.choice(_WORDS).capitalize(), f"Old {r.choice(_WORDS).capitalize()}", f"Saint {r.choice(self.given)}"))
        return f"{base} {r.choice('Street Lane Road Terrace Close Row Walk Avenue Square St. Rd. Ave. Ln.'.split())}"

    def address(self) -> str:
        r = self.r
        no = r.choice((str(r.randint(1, 220)), f"{r.randint(1, 220)}{r.choice('abc')}", f"{r.randint(1, 90)}–{r.randint(91, 180)}", str(r.randint(1, 99))))
        kind = r.random()
        if kind < 0.6:
            text = f"{no}{r.choice(('', '', ','))} {self.street()}"
        elif kind < 0.78:
            text = f"{no}, {r.choice('rue avenue quai impasse place'.split())} {r.choice(('des', 'du', 'de'))} {r.choice(self.family)}"
        else:
            text = f"{r.choice((r.choice(self.family) + r.choice(('strasse', 'gasse', 'weg')), f'Am {r.choice(self.family)}', f'Am Alten {r.choice(self.family)}', f'{r.choice(self.family)}er Weg', 'Uferweg'))} {r.randint(1, 190)}"
        return text.lower() if (case := r.random()) < 0.1 else text.upper() if case < 0.18 else text

    def note(self) -> tuple[str, set[tuple[int, int, str]]]:
        """A note and its true segments."""
        r = self.r
        place = r.choice(self.family) + r.choice(("", "ton", "ford"))
        slots = {
            "N": ("name", self.name), "M": ("name", self.name), "U": ("name", self.unlisted),
            "day": ("", lambda: r.choice("Monday Tuesday Friday Sunday".split())), "month": ("", lambda: r.choice("March June October".split())), "adj": ("", lambda: r.choice("Great Red Old Upper White Grand".split())), "Adj": ("", lambda: r.choice("Poor Old Little Young Great New".split())),
            "spot": ("", lambda: r.choice("Bridge Harbour Lion Lake Tower Gate Market River Hall Church".split())), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("idnum", self.idnum), "A": ("address", self.address),
            "thing": ("", lambda: r.choice("book copy volume scan manuscript binding".split())), "title": ("", lambda: r.choice("Captain Mrs. Mr. Doctor Miss Madame Herr Lady".split())), "title2": ("", lambda: r.choice(("Mrs.", "Mr.", "Miss", "Captain"))),
            "F": ("", lambda: r.choice(self.family)), "G": ("", lambda: r.choice(self.given)), "g": ("", lambda: r.choice(self.given).lower()), "story": ("", lambda: (r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_ONSET) + r.choice(_VOWEL)).capitalize()), "T": ("", lambda: place), "S": ("", self.street),
            "w": ("", lambda: r.choice(_WORDS)), "U": ("", lambda: r.choice("AQRS")), "year": ("", lambda: str(r.randint(1800, 1999))), **{f"d{n}": ("", lambda n=n: str(r.randint(10 ** (n - 1), 10**n - 1))) for n in (1, 2, 3, 4)},
        }
        patterns = [r.choice(r.choices((_WITH, _WITHOUT, _WITH_OTHERS, _WITHOUT_OTHERS), (0.44, 0.34, 0.11, 0.11))[0]) for _ in range(r.randint(1, 3))]
        text, truth = "", set()
        for k, pattern in enumerate(patterns):
            if k:
                text += r.choice(("\n\n", " ", " ", "\n", "  "))
            elif r.random() < 0.5:
                text += " ".join(r.choice(_WORDS) for _ in range(5)).capitalize() + ". "
            for part in re.split(r"(\{\w+\})", pattern):
                if part.startswith("{"):
                    kind, draw = slots[part[1:-1]]
                    value = draw()
                    if kind:
                        truth.add((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += part
        if r.random() < 0.3:  # wrapped lines: a blank becomes a line end, offsets stay
            text = "".join("\n" if c == " " and r.random() < 0.12 and text[i - 1:i] != "\n" and text[i + 1:i + 2] not in (" ", "\n") else c for i, c in enumerate(text))
        return text, truth


def training_set(sentences: int = SENTENCES, seed: int = 10):
    """(lexicon, [(text, true segments)]): the features see the listed names only."""
    from loomgraph.llm.pii import Lexicon

    draw = _Draw(seed)
    return Lexicon(draw.listed_given, draw.listed_family), [draw.note() for _ in range(sentences)]


@lru_cache(maxsize=4)
def trained_weights(sentences: int = SENTENCES, seed: int = 10) -> dict[str, float]:
    """Weights of the segment model; small ones are left out."""
    from loomgraph.llm.pii import SemiMarkov, candidates

    lexicon, notes = training_set(sentences, seed)
    model = SemiMarkov.fit([(candidates(text, lexicon), truth) for text, truth in notes])
    return {f: round(v, 4) for f, v in model.weights.items() if abs(v) > 0.02}
