"""XML read into maps: the one place where a row needs Python.

Spark's own `from_xml` needs a fixed shape and, building a reader per value, took seven times as
long per log as this.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.fixed import WINDOWS_NAMESPACE, XML_ALIASES

#: For each name that may stand for a field: the fields, and how far down their lists it comes.
_STANDS_FOR: dict[str, list[tuple[str, int]]] = {}
for _field, _names in XML_ALIASES.items():
    for _rank, _name in enumerate(_names):
        _STANDS_FOR.setdefault(_name, []).append((_field, _rank))

_JSON = json.JSONEncoder(ensure_ascii=False).encode


class _Open:
    """An element that is being read. `members` has what its attributes and closed children give, by
    name; `plain` the texts below each name, in document order, of names that came once."""

    __slots__ = ("members", "plain", "children")

    def __init__(self, attributes: dict[str, str]):
        self.members: dict[str, object] = dict(attributes)
        self.plain = {k: [(k, v)] for k, v in attributes.items()}
        self.children = 0

    def close(self, text: str) -> object:
        """What the element stands for: its text, or its members if it has any."""
        if not self.children and text:
            if not self.members:
                return text
            self.members["text"] = text
            self.plain["text"] = [("text", text)]
        return self.members if self.members or self.children else ""

    def take(self, name: str, value: object, child: _Open | None) -> None:
        """A closed child; None stands for one of text only."""
        self.children += 1
        if child is not None and name.lower() == "data" and "Name" in child.members and isinstance(value, dict):
            # An item that carries its own name: the last one of a name holds.
            name, value = value["Name"], value.get("text", "")
            self.members[name] = value
            self.plain[name] = [(name, value)] if isinstance(value, str) else child.plain["text"]
        elif name in self.members:
            before = self.members[name]
            self.members[name] = [*before, value] if isinstance(before, list) else [before, value]
            self.plain[name] = []
        else:
            self.members[name] = value
            self.plain[name] = [(name, value)] if isinstance(value, str) else list(child.found())

    def found(self):
        return chain.from_iterable(self.plain[name] for name in self.members)


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if element.tag[:1] == "{" else element.tag


def read_members(text: str) -> tuple[object, list[tuple[str, str]]]:
    """The root's value and the texts below it, in one walk over its elements."""
    root = ET.XML(text)
    way = [(root, _Open(root.attrib), iter(root))]
    while True:
        element, here, rest = way[-1]
        for child in rest:
            if len(child) or child.attrib:
                way.append((child, _Open(child.attrib), iter(child)))
                break
            here.take(_name(child), (child.text or "").strip(), None)
        else:
            way.pop()
            value = here.close((element.text or "").strip())
            if not way:
                return value, list(here.found())
            way[-1][1].take(_name(element), value, here)


def flatten(text: str | None) -> dict[str, str] | None:
    """The root's members, then texts from further down under names still free, then the fields that
    some name stands for. Members with parts of their own become JSON. Null if it is not XML."""
    if text is None:
        return None
    try:
        root, below = read_members(text)
    except Exception:
        return None
    if isinstance(root, str):
        return {"source_type": "xml", "content": root}
    record: dict[str, object] = dict(reversed(below)) | {"source_type": "xml"} | root  # of equal names below, the first
    best: dict[str, tuple[int, str]] = {}
    for name, value in record.items():
        if name in _STANDS_FOR and isinstance(value, str):
            for field, rank in _STANDS_FOR[name]:
                best[field] = min(best.get(field, (rank, name)), (rank, name))
    record = {field: record[name] for field, (_, name) in best.items()} | record
    return {k: v if isinstance(v, str) else _JSON(v) for k, v in record.items()}


_SPACE = f"{{{WINDOWS_NAMESPACE}}}"

#: Where a Windows event has its fixed parts, below System: element, attribute (none: the text), field.
_SYSTEM_PARTS = [
    (_SPACE + "EventID", None, "event_type"), (_SPACE + "TimeCreated", "SystemTime", "timestamp"),
    (_SPACE + "Computer", None, "hostname"), (_SPACE + "Provider", "Name", "application"),
]


def windows_event(text: str | None) -> dict[str, str | None] | None:
    """The known parts of a Windows event; its data items have '@' before their name."""
    if text is None:
        return None
    try:
        event = ET.XML(text)
    except Exception:
        return {}
    first: dict[str, ET.Element] = {}
    for system in event.iterfind(_SPACE + "System"):
        for part in system:
            first.setdefault(part.tag, part)
    known = {field: first[tag].text if attribute is None else first[tag].get(attribute) for tag, attribute, field in _SYSTEM_PARTS if tag in first}
    data = event.find(_SPACE + "EventData")
    for item in () if data is None else data:
        if item.tag == _SPACE + "Data" and item.get("Name"):
            known["@" + item.get("Name")] = item.text
    return known


TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _maps(texts: pa.Array, read: Callable[[str], dict[str, str | None] | None]) -> pa.Array:
    """What `read` gives for each text, written straight into an Arrow array; most texts of a batch are null."""
    ends: list[int | None] = []
    names: list[str] = []
    values: list[str | None] = []
    for text in texts.to_pylist():
        found = None if text is None else read(text)
        ends.append(None if found is None else len(names))
        if found:
            names.extend(found)
            values.extend(found.values())
    ends.append(len(names))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


@F.arrow_udf(TEXT_MAP)
def xml_map(text: pa.Array) -> pa.Array:
    return _maps(text, flatten)


@F.arrow_udf(TEXT_MAP)
def windows_map(text: pa.Array) -> pa.Array:
    return _maps(text, windows_event)
