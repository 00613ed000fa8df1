"""Plain pages fed to an ``HTMLParser`` by one expression; a page with anything out of the ordinary is left to the parser itself."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

_SPACE = r"[ \t\n\r\f]"
_NAME = r"[a-zA-Z][a-zA-Z0-9_:-]*+"
#: A whole tag as nearly all pages have them, with no character reference in an attribute and no ``<`` but the first.
_TAG = re.compile(rf"""<(/)?([a-zA-Z][a-zA-Z0-9]*+)(?(1){_SPACE}*+|((?:{_SPACE}++{_NAME}(?:=(?:"[^"<&]*+"|'[^'<&]*+'|[^\s"'<>=`&][^\s"'<>`&]*+(?=[ \t\n\r\f>])))?)*+){_SPACE}*+(/?))>""")
_ATTRIBUTE = re.compile(rf"""{_SPACE}({_NAME})(=)?(?:(?<==)(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f]++)))?""")
#: Elements whose content isn't markup, in this version of the parser or another.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext svg math".split())


def _attributes(text: str) -> list[tuple[str, str | None]]:
    return [(name.lower(), (a or b or c) if told else None) for name, told, a, b, c in _ATTRIBUTE.findall(text)]


def read(parser: HTMLParser, page: str) -> None:
    """Calls what ``parser.feed(page)`` and ``parser.close()`` call, in the same order with the same arguments."""
    parts = _TAG.split(page)
    tags = [tag.lower() for tag in parts[2::5]]
    if page.count("<") != len(tags) or not _RAW.isdisjoint(tags):
        parser.feed(page)
        parser.close()
        return
    start, startend, end, data = parser.handle_starttag, parser.handle_startendtag, parser.handle_endtag, parser.handle_data
    if parts[0]:
        data(unescape(parts[0]))
    for shut, tag, attributes, bare, text in zip(parts[1::5], tags, parts[3::5], parts[4::5], parts[5::5]):
        if shut:
            end(tag)
        else:
            (startend if bare else start)(tag, _attributes(attributes) if attributes else [])
        if text:
            data(unescape(text) if "&" in text else text)
