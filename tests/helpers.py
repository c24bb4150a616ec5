"""Independent restatements in plain Python that the operators are held against."""

import random
import re


def column(spark, expression, rows, names=("x",)):
    """Values of a column expression over rows of strings."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)],
                               "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def random_markdown(rng: random.Random) -> str:
    pieces = ["plain words", "  more text  ", "", "   ", "# Title", "    # not", "## Part two", "- item", "*x", "3. third", "| a | b |", "|",
              "```", "```py", "  ```", "code `x` here", "　wide　", "a\tb", "- ", "##no", "x y", "\x1csep"]
    return "\n".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14)))


def segments(text: str) -> list[tuple[str, str]]:
    """By scanning for whole blocks, line by line, with an index."""
    def tidy(s):
        return re.sub(r"[ \t]+", " ", s).strip()

    lines, out, i = re.sub(r"\r\n?", "\n", text).split("\n"), [], 0

    def kind(x):
        if x.lstrip().startswith("```"):
            return "code"
        if not x.strip():
            return "blank"
        if re.match(r"\s{0,3}#{1,6}\s+\S", x):
            return "heading"
        if re.match(r"\s{0,3}(?:[-*+]|\d+\.)\s+\S", x):
            return "list"
        return "table" if x.strip()[0] == "|" == x.strip()[-1] else "paragraph"

    while i < len(lines):
        k = kind(lines[i])
        if k == "code":
            j = next((n for n in range(i + 1, len(lines)) if kind(lines[n]) == "code"), len(lines) - 1)
            out.append((k, "\n".join(lines[i : j + 1]).strip()))
        elif k == "paragraph":
            j = i
            while j + 1 < len(lines) and kind(lines[j + 1]) == "paragraph":
                j += 1
            out.append((k, tidy(" ".join(x.strip() for x in lines[i : j + 1]))))
        else:
            j = i
            if k != "blank":
                out.append((k, tidy(lines[i])))
        i = j + 1
    return [x for x in out if x[1]]


def packed(parts: list[str], size: int) -> list[str]:
    """Packing as a list of open parts whose joined length is measured anew each time."""
    done, cur = [], []

    def shut():
        if cur:
            done.append("\n\n".join(cur))
            cur.clear()

    for part in parts:
        whole = len(part) <= size
        units = [part] if whole else [p for p in part.split("\n\n") if p.strip()]
        if cur and len("\n\n".join(cur)) + 2 + len(part) > size:
            shut()
        for u in units:
            if cur and len("\n\n".join(cur)) + 2 + len(u) > size:
                shut()
            if len(u) > size:
                shut()
                done += [u[k : k + size] for k in range(0, len(u), size)]
            else:
                cur.append(u)
    shut()
    return done or [""]
