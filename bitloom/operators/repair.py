"""Repairing Markdown that a translation step has damaged.

The steps run over protected regions too if they were restored before; a step may also change
text that only looks like damage (a line that begins with bold text, a rule, two bold spans in a line).
"""

from __future__ import annotations

from pyspark.sql import Column

from bitloom.functions.text import WS, sub

# Pattern and replacement of each step, in order.
STEPS = (
    (r"\*\*[ \t]+([^\n]*?)\*\*", "**$1**"),
    (r"\*\*([^\n]*?)[ \t]+\*\*", "**$1**"),
    (rf"(?dmU)^([{WS}]*)([-*+])([^{WS}])", "$1$2 $3"),
    (r"(?dm)^[ \t]*```([^\n`]*?)[ \t]+$", "```$1"),
    (r"\][ \t]+\(", "]("),
    (r"[ \t]+(\{\{PH_[A-Z_0-9]+\}\})", "$1"),
    (r"(\{\{PH_[A-Z_0-9]+\}\})[ \t]+", "$1"),
)


def repair(text: Column) -> Column:
    for pattern, replacement in STEPS:
        text = sub(text, pattern, replacement)
    return text
