"""IP address tests as single regular expressions, so that no Python is needed."""

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


def _ipv6() -> str:
    """All spellings: eight groups, or one '::' standing for at least one group; an IPv4 tail counts as two."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [f"(?:{h}:){{7}}{h}", f"(?:{h}:){{6}}{IPV4}"]
    for left in range(8):
        head = "" if left == 0 else f"{h}(?::{h}){{{left - 1}}}"
        room = 7 - left
        tails = []
        if room >= 1:
            tails.append(f"{h}(?::{h}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(f"(?:{h}:){{0,{room - 2}}}{IPV4}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        forms.append(f"{head}::{tail}")
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


IP_PATTERN = f"^(?:{IPV4}|{_ipv6()})$"


def is_ip(value: Column) -> Column:
    # '$' would also match before a final line break, so such text is refused first.
    return ~F.contains(value, F.lit("\n")) & value.rlike(IP_PATTERN)
