"""Search text: stop words and the web-search query syntax (words, "phrases", OR, -not)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words too common to search for, the customary English list.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
    am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


@dataclass
class Group:
    """Phrases (a word is a phrase of one) of which all must occur, and those of which none may."""

    need: list[list[str]] = field(default_factory=list)
    never: list[list[str]] = field(default_factory=list)


def parse(query: str) -> list[Group]:
    """Alternatives, parted by OR, of a query in web-search syntax. Odd quotes and signs are no errors."""
    groups = [Group()]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if word == "OR" and not sign:
            groups.append(Group())
            continue
        found = words(phrase or word)
        if found:
            (groups[-1].never if sign else groups[-1].need).append(found)
    return [g for g in groups if g.need or g.never]
