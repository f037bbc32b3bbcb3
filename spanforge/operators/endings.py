"""Endings of Turkish words as a finite automaton, and what a word becomes before them.

Letters are folded (no marks), so a / e stay apart and i / u stand for four vowels.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings themselves. A: a or e, I: i or u, D: d or t, K: k or g, V: a, e, i or u, B: y or n; (x): x may be left out.
PLURAL = ["lAr"]
POSSESSIVE = ["ImIz", "InIz", "mIz", "nIz", "lArI", "Im", "In", "sI", "m", "n", "I"]
CASE = ["(n)DAn", "(n)DA", "(n)In", "(y)lA", "(B)I", "(B)A"]
RELATIVE = ["ki"]
VOICE = ["DIr", "Il", "In", "t"]
CAN, UNABLE = ["(y)Abil"], ["(y)A"]
NEGATION = ["mV"]
TENSE = ["Iyor", "yor", "DI", "mIs", "(y)AcAK", "Ar", "Ir", "r", "z", "mAlI", "sA"]
PERSON = ["Im", "sInIz", "sIn", "Iz", "lAr", "yIm", "yIz", "m", "n", "k"]
CERTAIN = ["dIr"]
SPOKEN = ["(y)IcAm", "(y)IcAn", "(y)IcAz", "cAm", "cAn", "cAz", "(y)Iyo", "(y)Iyom", "(y)Iyon"]
WISH = ["sIn", "sInlAr", "(y)In", "(y)InIz", "(y)AyIm", "(y)AlIm", "sAnA", "(y)Am"]
LINKING = ["mAk", "mAdAn", "(y)Ip", "(y)ArAk", "(y)IncA"]
PARTICIPLE, AGENT, NOUN = ["DIK"], ["(y)An"], ["mA"]
# The longest ending; endings of English words; what a last letter softens to before a vowel.
LONGEST, ENGLISH = 14, ["s", "es", "ed", "d", "ing", "er"]
SOFTENED = {"k": "g", "p": "b", "t": "d"}
_CLASSES = {"A": "ae", "I": "iu", "D": "dt", "K": "kg", "V": "aeiu", "B": "yn"}

#: What follows what: (from, endings, to); the empty ending goes on at once. 'end' is where a word may end.
NOUN_FORMS = [("start", ["", *PLURAL], "owned"), ("owned", ["", *POSSESSIVE], "case"), ("case", ["", *CASE], "of"), ("of", ["", *RELATIVE], "end")]
_SAID = [("said", TENSE, "who"), ("who", ["", *PERSON], "sure"), ("sure", ["", *CERTAIN], "end"), ("said", SPOKEN + WISH, "end")]
_VOICES = [("start", ["", *VOICE], "voice"), ("voice", ["", *VOICE], "able")]
VERB_FORMS = [
    *_VOICES, ("able", ["", *CAN], "negated"), ("negated", ["", *NEGATION], "said"), *_SAID, ("negated", LINKING, "end"), ("negated", NOUN, "end"),
    ("negated", PARTICIPLE, "held"), ("negated", NOUN, "held"), ("held", ["", *POSSESSIVE], "held_case"), ("held_case", ["", *CASE], "end"), ("negated", AGENT, "many"), ("many", ["", *PLURAL], "held_case"),
    # unable: the vowel stands only before m and a vowel, which negate or begin what follows
    ("able", UNABLE, "cannot"), ("cannot", NEGATION, "said"), ("cannot", ["mIs", "mAlI"], "who"), ("cannot", ["mAk", "mAdAn", *NOUN], "end"), ("cannot", NOUN, "held"),
]
NEGATIVE_FORMS = [*_VOICES, ("able", ["", *UNABLE], "cannot"), ("cannot", NEGATION, "said"), *_SAID]


def spellings(ending: str) -> list[str]:
    """All that an ending stands for."""
    if "(" in ending:
        a, b = ending.index("("), ending.index(")")
        return spellings(ending[:a] + ending[b + 1 :]) + spellings(ending[:a] + ending[a + 1 : b] + ending[b + 1 :])
    out = [""]
    for c in ending:
        out = [x + y for x in out for y in _CLASSES.get(c, c)]
    return out


def automaton(forms: list[tuple[str, list[str], str]], more: list[tuple[str, list[str], str]] = ()) -> list[list[int]]:
    """A table of transitions, table[state][letter], of the words that forms (and, from the same start, more) allow. State 0 takes
    nothing any more, 1 is the start, and a state's last entry tells whether a word may end there."""
    arcs: dict[str, list[tuple[str, str]]] = {}  # letter or '' to the next node; nodes within an ending are named after it
    for tag, rules in (("1", forms), ("2", more)):
        name = lambda n, tag=tag: n if n in ("start", "end") else tag + n
        for a, endings, b in rules:
            for word in {s for e in endings for s in spellings(e)}:
                at = name(a)
                for k, c in enumerate(word):
                    to = name(b) if k == len(word) - 1 else f"{tag}{a}>{b}:{word[: k + 1]}"
                    arcs.setdefault(at, []).append((c, to))
                    at = to
                if not word:
                    arcs.setdefault(at, []).append(("", name(b)))

    def closed(nodes: set[str]) -> frozenset[str]:
        todo, out = list(nodes), set(nodes)
        while todo:
            for c, to in arcs.get(todo.pop(), []):
                if not c and to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    number = {frozenset(): 0, closed({"start"}): 1}
    table: list[list[int]] = []
    for nodes in (order := list(number)):  # grows as states are found
        row = []
        for c in "abcdefghijklmnopqrstuvwxyz":
            to = closed({t for n in nodes for x, t in arcs.get(n, []) if x == c})
            if to not in number:
                number[to] = len(number)
                order.append(to)
            row.append(number[to])
        table.append([*row, int("end" in nodes)])
    return smallest(table)


def smallest(table: list[list[int]]) -> list[list[int]]:
    """The same with states that no word tells apart made one."""
    kind = [row[-1] for row in table]
    while True:
        seen: dict[tuple, int] = {}
        signs = [(kind[k], *(kind[to] for to in row[:-1])) for k, row in enumerate(table)]
        now = [seen.setdefault(s, len(seen)) for s in signs]
        if len(seen) == len(set(kind)):
            break
        kind = now
    first = {}
    for k, c in enumerate(kind):
        first.setdefault(c, k)
    order = [kind[0], kind[1], *(c for c in first if c not in (kind[0], kind[1]))]
    place = {c: k for k, c in enumerate(order)}
    return [[*(place[kind[to]] for to in table[first[c]][:-1]), table[first[c]][-1]] for c in order]


@cache
def _table(negative: bool) -> list[list[int]]:
    return automaton(NEGATIVE_FORMS) if negative else automaton(NOUN_FORMS, VERB_FORMS)


def ends(rest: Column, negative: bool = False) -> Column:
    """Whether the letters after a word are an ending (negative: one that says that something isn't or can't be). None is an
    ending, but not a negative one. The automaton steps over the letters; a row of its table is a string whose letters
    tell the next state."""
    table = _table(negative)
    rows = F.array(*(F.lit("".join(chr(97 + to) for to in row)) for row in table))
    step = lambda s, c: F.when((c >= "a") & (c <= "z"), F.ascii(F.substring(F.get(rows, s), F.ascii(c) - 96, F.lit(1))) - 97).otherwise(0)
    last = F.aggregate(F.filter(F.split(rest, ""), lambda c: c != ""), F.lit(1), step)
    fine = F.get(F.array(*(F.lit(bool(row[-1])) for row in table)), last)
    return (F.length(rest) <= LONGEST) & fine & ((F.length(rest) > 0) if negative else F.lit(True))


def ends_sql(rest: str, negative: bool = False) -> str:
    """The same in SQL: a list of all transitions, 27 for each state."""
    table = _table(negative)
    flat = [to for row in table for to in row]
    letters = f"list_transform(string_split({rest}, ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' AND c <> '' THEN ascii(c) - 97 ELSE 99 END)"
    last = f"list_reduce(list_prepend(1, CASE WHEN {rest} = '' THEN [] ELSE {letters} END), lambda s, c: CASE WHEN c > 25 THEN 0 ELSE {flat}[s * 27 + c + 1] END)"
    return f"(length({rest}) <= {LONGEST} AND {flat}[({last}) * 27 + 27] = 1{' AND length(' + rest + ') > 0' if negative else ''})"


def surfaces(word: str) -> list[tuple[str, str]]:
    """(letters, need): what a word may look like before an ending. need: 'any' ending; a 'vowel' after a softened last letter;
    a 'narrow' one, before which a verb's last a or e is lost."""
    out = [(word, "any")]
    if word[-1] in SOFTENED:
        out.append((word[:-1] + SOFTENED[word[-1]], "vowel"))
    if word[-1] in "ae" and len(word) >= 3:
        out.append((word[:-1], "narrow"))
    return out


# What the letters after a word have to look like, by need.
NEEDS = {"any": "", "vowel": "^[aeiou]", "narrow": "^[iu](yo|c[ae])"}
