"""Text of bodies: by byte-order mark, declared charset, meta element, or the shape of the bytes; no page is dropped.

UTF-8 is decoded by Spark itself; only bodies in other charsets go to Python, in Arrow batches.
"""

from __future__ import annotations

import codecs
import re
from encodings.aliases import aliases

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import by_row

#: Which codecs web pages may name; transformations and codecs that no page may name are not among them.
_TEXT = re.compile(r"cp\d+|iso8859_\d+|latin_1|koi8_[ru]|mac_(roman|cyrillic)|gb\w+|big5\w*|shift_jis|euc_(jp|kr)|iso2022_jp|utf_8|utf_16(_[bl]e)?|tis_620|ascii|hz")
#: Labels that Python's registry lacks, and the larger charsets that web labels stand for.
_MORE = {"x_sjis": "cp932", "windows_31j": "cp932", "x_gbk": "gb18030", "x_x_big5": "big5hkscs", "x_mac_roman": "mac_roman", "x_mac_cyrillic": "mac_cyrillic", "unicode_1_1_utf_8": "utf_8", "unicode": "utf_16_le", "x_cp1250": "cp1250", "x_cp1251": "cp1251", "x_cp1252": "cp1252", "dos_874": "cp874"}
_WIDER = {"latin_1": "cp1252", "ascii": "cp1252", "iso8859_9": "cp1254", "iso8859_11": "cp874", "tis_620": "cp874", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "euc_kr": "cp949", "big5": "big5hkscs", "utf_16": "utf_16_le"}


def _labels() -> dict[str, str]:
    """Every label, in lower case with _ between its parts, and its codec."""
    found = {name: module for name, module in aliases.items() if _TEXT.fullmatch(module)}
    found |= {module: module for module in list(found.values())} | {f"iso_8859_{n}": f"iso8859_{n}" for n in (*range(2, 12), *range(13, 17))} | {f"windows_{n}": f"cp{n}" for n in range(1250, 1259)} | _MORE
    return {label: _WIDER.get(module, module) for label, module in found.items()}


LABELS = _labels()
UTF8 = sorted(label for label, codec in LABELS.items() if codec == "utf_8")


def _as_they_are(e: UnicodeError) -> tuple[str, int]:
    """Bytes that a single-byte charset leaves open stand for themselves."""
    return "".join(map(chr, e.object[e.start : e.end])), e.end


codecs.register_error("grainmill.open", _as_they_are)


def decode_bytes(body: bytes, label: str) -> str:
    codec = LABELS[label]
    return body.decode(codec, "grainmill.open" if re.match(r"cp(12|874)", codec) else "replace")


def _other(body: bytes | None, label: str | None) -> str | None:
    return None if body is None else decode_bytes(body, label)


def _normal(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_")


def charset(body: Column, content_type: Column) -> Column:
    """The label of a body's charset."""
    head = F.hex(F.substring(body, 1, 3))
    mark = F.when(head == "EFBBBF", "utf_8").when(head.startswith("FEFF"), "utf_16_be").when(head.startswith("FFFE"), "utf_16_le")
    known = lambda x: F.when(x.isin(sorted(LABELS)), x)
    declared = known(_normal(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([A-Za-z0-9_.:\-]+)", 1)))
    meta = known(_normal(F.regexp_extract(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"), r"(?is)<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:\-]+)", 1)))
    meta = F.when(meta.startswith("utf_16"), "utf_8").otherwise(meta)  # bytes that can be read as ASCII are not UTF-16
    return F.coalesce(mark, declared, meta, F.when(F.is_valid_utf8(body.cast("string")), "utf_8").otherwise("windows_1252"))


def decode(body: Column, content_type: Column) -> Column:
    """Text of a binary body; a null body is an empty text."""
    label = charset(body, content_type)
    own = F.coalesce(label.isin(UTF8), F.lit(True))
    others = by_row(_other, "string")
    text = F.when(own, F.make_valid_utf8(body.cast("string"))).otherwise(others(F.when(~own, body), label))
    return F.regexp_replace(F.coalesce(text, F.lit("")), "^\\uFEFF", "")
