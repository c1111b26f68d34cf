"""Accuracy of the segment model on notes of other patterns than those it is trained on.

Patterns, names and number formats here were written for this test and are used nowhere else; the
training patterns must not be adapted to them.
"""

import random
import re

from loomgraph.llm import pii, pii_training

GIVEN = "Rowena Tobias Ingrid Marcel Beatrix Anselm Priya Joachim Lucinda Oskar Yvonne Desmond Farah Gideon Helga Ignacio".split()
FAMILY = "Pemberton Lachlan Osterman Quigley Vasquez Thornbury Delacroix Nakamura Brandt Winslow Aldous Kirkpatrick Soames Ferreira Holloway Lindqvist".split()
LISTED_GIVEN, LISTED_FAMILY = GIVEN[::2], FAMILY[::2]
WITH = (
    "The parcel is for {N}, {A}.", "Invoice to {N}, {A}, due at the end of the month.", "Kind regards, {N} ({E})", "Please forward this letter to {N} at {A}.", "For repairs call {N} on {P}.", "You can reach me at {E} or on {P}.",
    "Membership of {N}, passport number {I}, expires soon.", "My identity card {I} was issued last year.", "We moved to {A} in spring.", "This copy was presented to {N} by the society.", "Received from {N} with thanks.", "Visitors should write to {E}.",
    "Emergency number: {P}.", "Insurance no. {I} belongs to {N}.", "{N} lives at {A}.", "Tickets are held for {N}; telephone {P}.", "Best wishes from {N}", "Enquiries: {N}, {P}.", "Lost: one umbrella. Finder please mail {E}.", "Attention of {N}, {A}.",
)
WITHOUT = (
    "Chapter {d} tells how {G} crossed the river.", "The year {y} was cold.", "Mister {F} shut the gate behind him.", "\"Come in,\" said {G}, and closed the door.", "See volume {d}, pages {d}–{d}.", "Old Aunt {F} kept bees.", "ISBN 978-0-306-40615-{d}.",
    "They rowed down to the Great Lake and back.", "On Monday the Red Lion was empty.", "Shelf mark B {d}.{d} is missing.", "In {y} the bridge fell.", "He counted {d}, then {d} more.", "The North Wind blew for {d} days.",
)


def draw(seed, n):
    r = random.Random(seed)
    digits = lambda form: "".join(str(r.randint(0, 9)) if c == "#" else c for c in form)
    name = lambda: r.choice((f"{r.choice(GIVEN)} {r.choice(FAMILY)}", f"{r.choice(GIVEN)} {r.choice(FAMILY)}", f"{r.choice(GIVEN)} {r.choice('BDLMW')}. {r.choice(FAMILY)}", f"{r.choice(FAMILY)}, {r.choice(GIVEN)}"))
    slots = {
        "N": ("name", name), "E": ("email", lambda: f"{r.choice(GIVEN).lower()}{r.choice('._')}{r.choice(FAMILY).lower()}@{r.choice(('posthouse.net', 'library.example', 'mail.co.example'))}"),
        "P": ("phone", lambda: digits(r.choice(("+44 20 #### ####", "(0131) 496 ####", "555-01##-####", "+1 (555) 010-####", "0#### ######", "+49 ### #######")))), "I": ("idnum", lambda: digits(r.choice(("#########", "AB######", "XK-######-#", "### ### ###", "C########")))),
        "A": ("address", lambda: r.choice((f"{r.randint(1, 240)} {r.choice(('Mill', 'Orchard', 'Station', 'Castle', 'Bishop'))} {r.choice(('Lane', 'Street', 'Road', 'Avenue', 'Terrace'))}", f"{r.randint(1, 90)}{r.choice('abc')} {r.choice(('Saint Olave', 'Fountain', 'New Harbour'))} {r.choice(('Street', 'Close', 'Square'))}"))),
        "G": ("", lambda: r.choice(GIVEN)), "F": ("", lambda: r.choice(FAMILY)), "d": ("", lambda: str(r.randint(2, 99))), "y": ("", lambda: str(r.randint(1700, 1999))),
    }
    for _ in range(n):
        text, truth = "", set()
        for part in re.split(r"(\{\w\})", r.choice(WITH if r.random() < 0.65 else WITHOUT)):
            kind, value = ("", part)
            if part.startswith("{"):
                kind, value = slots[part[1:-1]][0], slots[part[1:-1]][1]()
            if kind:
                truth.add((len(text), kind))
            text += value
        yield text, truth


def measured(notes):
    redactor = pii.Redactor(LISTED_GIVEN, LISTED_FAMILY, pii_training.trained_weights())
    found = right = true = 0
    wrong = []
    for text, truth in notes:
        got = {(a, k) for a, _, k, _ in redactor.find(text)}
        found, right, true = found + len(got), right + len(got & truth), true + len(truth)
        if got != truth:
            wrong.append((text, sorted(got - truth), sorted(truth - got)))
    return right / found, right / true, wrong


def test_accuracy_on_notes_of_other_patterns():
    precision, recall, _ = measured(draw(77, 1500))
    assert precision >= 0.9 and recall >= 0.9


def test_long_user_part_is_read_to_its_start():
    user = "a" * 70 + ".b"
    text = f"Write to {user}@example.org today."
    redactor = pii.Redactor([], [], pii_training.trained_weights())
    assert redactor.redact(text) == "Write to [EMAIL] today."


def test_a_name_of_two_unlisted_parts():
    redactor = pii.Redactor(["Anna"], ["Mehlfeld"], pii_training.trained_weights())
    assert redactor.redact("The parcel is for Zorvan Quillith, 12 Mill Lane.") == "The parcel is for [NAME], [ADDRESS]."
    for story in ("They rowed to the Great Lake at dawn.", "Old Thornwick and the River Gate were far behind.", "On Monday the Red Lion was empty."):
        assert redactor.redact(story) == story
