"""Pages as trees, read once, and values picked from them by rules that are data.

A rule says where a value stands (KINDS) by a selector of the usual kind: tags, ``#id``, ``.class`` and ``[attribute="value"]`` in one step, steps
parted by blanks (any depth), alternatives by commas. The text of an element is that of all its parts, each without blanks around it, joined; scripts and styles have none. Tags left open are
closed by their parents, and by the tags that can't stand inside of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import islice
from typing import NamedTuple

from . import markup

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tag: the open tags that it closes, up to the nearest of the tags that hold them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}), **dict.fromkeys("p div ul ol table h1 h2 h3 dl section article".split(), ({"p"}, {"div", "td", "li", "section", "article", "body"})),
}
_STEP = re.compile(r"""([a-zA-Z][\w-]*|\*)?((?:\#[\w-]+|\.[\w-]+|\[[\w:-]+(?:=["']?[^\]"']*["']?)?\])*)""")
_PART = re.compile(r"""\#([\w-]+)|\.([\w-]+)|\[([\w:-]+)(?:=["']?([^\]"']*)["']?)?\]""")
NUMBERS = re.compile(r"\d+\.?\d*")


class Element:
    __slots__ = ("tag", "attributes", "parent", "children", "place", "every", "short")  # place: among its parent's children; every: elements of a whole page; short: a bound and the text under it, once read

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None, place: int) -> None:
        self.tag, self.attributes, self.parent, self.children, self.place = tag, attributes, parent, [], place
        self.every = self.short = None

    def text(self, most: int | None = None) -> str:
        """The whole text, or what there is of it when it gets longer than ``most``."""
        if most is not None:
            if self.short is None or self.short[0] != most:
                self.short = most, self._text(most)
            return self.short[1]
        return self._text(None)

    def _text(self, most: int | None) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str) and self.tag not in ("script", "style"):
            return self.children[0].strip()
        out, todo, size = [], [self], 0
        while todo and (most is None or size <= most):
            x = todo.pop()
            if isinstance(x, str):
                out.append(x.strip())
                size += len(out[-1])
            elif x.tag not in ("script", "style"):
                todo.extend(reversed(x.children))
        return "".join(out)

    def next(self) -> Element | None:
        """The element after this one."""
        beside = self.parent.children if self.parent else []
        return next((beside[i] for i in range(self.place + 1, len(beside)) if isinstance(beside[i], Element)), None)

    def inside(self) -> Iterator[Element]:
        """Elements in document order."""
        return iter(self.every) if self.every is not None else self._inside()

    def _inside(self) -> Iterator[Element]:
        todo = [x for x in reversed(self.children) if isinstance(x, Element)]
        while todo:
            x = todo.pop()
            yield x
            todo.extend(y for y in reversed(x.children) if isinstance(y, Element))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Element("", {}, None, 0)
        self.top.every = self.every = []  # elements begin in document order

    def _close(self, tags: set[str], within: set[str]) -> None:
        x, last = self.at, None
        while x.parent is not None and x.tag not in within:
            if x.tag in tags:
                last = x
            x = x.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        made = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, len(self.at.children))
        self.at.children.append(made)
        self.every.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(page: str) -> Element:
    b = _Builder()
    markup.read(b, page)
    return b.top


@lru_cache(maxsize=1000)
def _steps(selector: str) -> tuple[frozenset[str] | None, list[list[tuple]]]:
    """Alternatives of steps of (tag, id, classes, attributes), and the tags that the last steps name; no alternatives if the tags alone tell, no tags if a last step names none."""
    out = []
    for way in selector.split(","):
        steps = []
        for step in re.findall(r"(?:\[[^\]]*\]|\S)+", way):
            m = _STEP.fullmatch(step)
            if not m:
                raise ValueError(f"not a selector: {step}")
            own_id, classes, attributes = None, set(), {}
            for i, c, name, value in _PART.findall(m[2]):
                own_id = i or own_id
                classes |= {c} if c else set()
                attributes |= {name: value} if name else {}
            steps.append((None if m[1] in (None, "*") else m[1], own_id, classes, attributes))
        out.append(steps)
    tags = {steps[-1][0] if steps else None for steps in out}
    alone = all(len(steps) == 1 and not any(steps[0][1:]) for steps in out)
    return (None, out) if None in tags else (frozenset(tags), [] if alone else out)


def _fits(x: Element, step: tuple) -> bool:
    tag, own_id, classes, attributes = step
    a = x.attributes
    return (tag is None or x.tag == tag) and (own_id is None or a.get("id") == own_id) and (not classes or classes <= set(a.get("class", "").split())) and (not attributes or all(k in a and (not v or a[k] == v) for k, v in attributes.items()))


def _chosen(x: Element, steps: list[tuple]) -> bool:
    if not _fits(x, steps[-1]):
        return False
    left, up = len(steps) - 2, x.parent
    while left >= 0 and up is not None:
        left -= _fits(up, steps[left])
        up = up.parent
    return left < 0


def select(root: Element, selector: str) -> Iterator[Element]:
    """Elements in document order."""
    tags, ways = _steps(selector)
    found = root.inside() if tags is None else (x for x in root.inside() if x.tag in tags)
    return (x for x in found if any(_chosen(x, w) for w in ways)) if ways else found


def marked(root: Element, tags: tuple[str, ...], words: tuple[str, ...]) -> Element | None:
    """The first element of one of ``tags`` (of any if there are none) with a class in which one of ``words`` stands, in either case (any class or none if there are none)."""
    for x in root.inside():
        if (not tags or x.tag in tags) and (not words or any(w in c for c in x.attributes.get("class", "").lower().split() for w in words)):
            return x
    return None


class Rule(NamedTuple):
    field: str
    kind: str
    selector: str
    names: tuple = ()  # labels, the attribute's name, or for rows labels with their fields


def _text(root: Element, rule: Rule) -> Iterator[str]:
    """The first element's text."""
    return (x.text() for x in select(root, rule.selector))


def _attribute(root: Element, rule: Rule) -> Iterator[str]:
    """An attribute of the first element."""
    return (x.attributes.get(rule.names[0], "") for x in select(root, rule.selector))


def _after_colon(root: Element, rule: Rule) -> Iterator[str]:
    """What follows the first colon of a text of fewer than 100 characters that has the label before it."""
    for x in select(root, rule.selector):
        text = x.text(100)
        if len(text) < 100 and ":" in text:
            head, value = text.split(":")[:2]
            if any(n in head for n in rule.names):
                yield value.strip()


def _next(root: Element, rule: Rule) -> Iterator[str]:
    """The text of the element after the one whose text holds a label."""
    for x in select(root, rule.selector):
        if any(n in x.text().lower() for n in rule.names) and (after := x.next()) is not None:
            yield after.text()


def _near(root: Element, rule: Rule) -> Iterator[str]:
    """The last number of a text of fewer than 50 characters with a label and a colon, or else the first number of the element after it."""
    for x in select(root, rule.selector):
        text = x.text(50)
        if len(text) < 50 and any(n.lower() in text.lower() for n in rule.names):
            if ":" in text and (found := NUMBERS.findall(text)):
                yield found[-1]
            elif (after := x.next()) is not None and (found := NUMBERS.findall(after.text())):
                yield found[0]


def _pair(root: Element, rule: Rule) -> Iterator[str]:
    """The first number in the second paragraph of an element whose first one holds a label."""
    for x in select(root, rule.selector):
        both = list(islice(select(x, "p"), 2))
        if len(both) == 2 and any(n.lower() in both[0].text().lower() for n in rule.names) and (found := NUMBERS.findall(both[1].text())):
            yield found[0]


def _term(root: Element, rule: Rule) -> Iterator[str]:
    """The first number of the definition that follows a term; the last such term counts."""
    met = [found[0] for x in select(root, "dt") if any(n in x.text() for n in rule.names) and (after := x.next()) is not None and after.tag == "dd" and (found := NUMBERS.findall(after.text()))]
    return iter(met[-1:])


def _rows(root: Element, rule: Rule) -> Iterator[tuple[str, str]]:
    """Of each table row, the field that the first fitting label names, and the texts of the cells beside the label, one under the other."""
    for row in select(root, rule.selector):
        cells = list(select(row, "td"))
        head = next(select(row, "th"), None)
        label, beside = (head.text(), cells) if head is not None else (cells[0].text(), cells[1:]) if cells else ("", [])
        field = next((f for n, f in rule.names if n in label.lower()), None) if label else None
        if field is not None:
            yield field, "\n".join(c.text() for c in beside)


KINDS = {"text": _text, "attribute": _attribute, "after colon": _after_colon, "next": _next, "near": _near, "pair": _pair, "term": _term}


def picked(root: Element, rules: list[Rule]) -> list[dict[str, str]]:
    """field and text, at most one for each rule but one for each row of tables, in the rules' order."""
    out = []
    for rule in rules:
        if rule.kind == "rows":
            out += [{"field": f, "text": t} for f, t in _rows(root, rule)]
            continue
        text = next((t for t in KINDS[rule.kind](root, rule) if t), None)
        if text is not None:
            out.append({"field": rule.field, "text": text})
    return out


def table_rows(root: Element, selector: str, least: int) -> list[list[str]]:
    """Cells of the body rows of the first table with a selector that have ``least`` cells or more."""
    found = next(select(root, selector), None)
    rows = [[c.text() for c in select(r, "td")] for r in select(found, "tbody tr")] if found is not None else []
    return [r for r in rows if len(r) >= least]
