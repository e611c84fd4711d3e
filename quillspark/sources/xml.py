"""Values in small pieces of XML.

XPath builds a tree for each call.  A pattern finds an attribute that stands behind
plain elements only, and the text of plain runs; XPath reads what may hold the value
in any other form, and what can't hold it is not parsed at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = r"[^\"<>&\t\r\n]*+"
ATTRIBUTES = rf"(?:\s++[\w.:-]++=\"{VALUE}\")*+\s*+"
#: Markup that patterns leave to XPath: comments, sections, instructions, line ends that a parser changes, and other entities than these.
MARKUP = ("<!", "<?", "\r")
OTHER_ENTITY = r"&(?!(?:lt|gt|quot|apos|amp|#13|#10|#9);)"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#13;", "\r"), ("&#10;", "\n"), ("&#9;", "\t"), ("&amp;", "&"))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _to(path: str) -> tuple[str, str]:
    """A pattern up to the path's last element, its name included, behind siblings without content; and that name."""
    *around, last = path.strip("/").split("/")
    behind = lambda tag: rf"(?:\s*+<(?!{tag}[\s/>])[\w.-]++{ATTRIBUTES}/>)*+\s*+"
    pattern = ""
    for k, tag in enumerate((*around, last)):
        pattern += (behind(tag) if k else "^") + (rf"<{tag}{ATTRIBUTES}>" if k < len(around) else rf"<{tag}")
    return pattern, last


def attribute(xml: Column, path: str) -> Column:
    """An attribute's value by a path of plain steps from the root; null where it is absent or empty."""
    elements, name = path.rsplit("/@", 1)
    parsed = F.nullif(F.xpath_string(xml, F.lit(path)), F.lit(""))
    if not re.fullmatch(r"(?:/\w+)+", elements):
        return parsed
    start, last = _to(elements)
    plain = F.nullif(F.regexp_extract(xml, rf"{start}(?:\s++[\w.:-]++=\"{VALUE}\")*?\s++{name}=\"({VALUE})\"", 1), F.lit(""))
    return F.when(F.contains(xml, F.lit(f"<{last}")), F.coalesce(plain, F.when(xml.rlike(rf"<{last}\s[^<]*\b{name}\s*="), parsed)))


def has(xml: Column, path: str) -> Column:
    """Whether there is an element at a path of plain steps from the root."""
    start, last = _to(path)
    return F.contains(xml, F.lit(f"<{last}")) & xml.rlike(rf"<{last}[\s/>]") & (xml.rlike(rf"{start}{ATTRIBUTES}/?>") | (F.size(F.xpath(xml, F.lit(path))) > 0))


def unescaped(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _odd(xml: Column) -> Column:
    odd = F.contains(xml, F.lit("&")) & xml.rlike(OTHER_ENTITY)
    for mark in MARKUP:
        odd = odd | F.contains(xml, F.lit(mark))
    return odd


def _inner(xml: Column, tags: str) -> Column:
    found = F.array_join(F.regexp_extract_all(xml, F.lit(rf"<(?:{tags}){ATTRIBUTES}>([^<]*+)</(?:{tags})>"), F.lit(1)), "")
    return F.when(F.contains(found, F.lit("&")), unescaped(found)).otherwise(found)


def _no_plain(tags: str) -> str:
    """A pattern of such an element that holds more than text, or whose tag isn't plain."""
    return rf"<(?:{tags})(?=[\s/>])(?!{ATTRIBUTES}(?:/>|>[^<]*+</(?:{tags})>))"


def run_text(run: Column) -> Column:
    """The text of a run's own `t` elements."""
    plain = rf"^<r{ATTRIBUTES}>(?:<rPr{ATTRIBUTES}>(?:<[\w.-]++{ATTRIBUTES}/>)*+</rPr>)?+(?:<t{ATTRIBUTES}>[^<]*+</t>|<[\w.-]++{ATTRIBUTES}/>)*+</r>$"
    return F.when(run.rlike(plain) & ~_odd(run), _inner(run, "t")).otherwise(F.array_join(F.xpath(run, F.lit("/r/t/text()")), ""))


def text_of(xml: Column, *tags: str, outside: str | None = None) -> Column:
    """The text of all elements of these names, at any depth, but for what is within elements of the name `outside`."""
    left = xml if outside is None else F.regexp_replace(xml, rf"<{outside}{ATTRIBUTES}>[^<]*+(?:<(?!/{outside}>)[^<]*+)*+</{outside}>", "")
    names = "|".join(tags)
    within = "" if outside is None else f"[not(ancestor::{outside})]"
    parsed = F.array_join(F.xpath(xml, F.lit(" | ".join(f"//{t}{within}/text()" for t in tags))), "")
    # an end tag that is left closes an element with another of its kind in it, or one whose tag isn't plain
    odd = _odd(xml) | xml.rlike(_no_plain(names))
    if outside is not None:
        odd = odd | F.contains(left, F.lit(f"</{outside}"))
    return F.when(odd, parsed).otherwise(_inner(left, names))
