"""Papers in Markdown against a plain reading, line by line."""

import random
import re

from ledgerlens.sources import documents as D


def plain(text):
    """(type, text, items, rows) of the blocks, by a loop over the lines."""
    ls = "".join(c for c in text.replace("\r\n", "\n").replace("\r", "\n") if c in "\t\n" or ord(c) >= 32).split("\n")
    top = next((i for i, x in enumerate(ls) if re.match(D._TITLE, x)), None)
    out, points = [], {"numlist": [], "bullet": []}
    head = [x for x in ls[:top] if x.strip()] if top is not None else []
    if head:
        out.append(("header", None, head, None))

    def flush():
        for k in ("numlist", "bullet"):
            if points[k]:
                out.append((k, None, points[k], None))
                points[k] = []

    rest = ls[top:] if top is not None else ls
    i = 0
    while i < len(rest):
        x, s = rest[i], rest[i].strip()
        m = {k: re.match(p, x) for k, p in (("t", D._TITLE), ("d", D._DATE), ("2", D._SECOND), ("r", D._ROW), ("q", D._QUOTE), ("n", D._NUMBERED), ("b", D._BULLET))}
        i += 1
        if not s:
            flush()
        elif m["t"]:
            flush()
            out.append(("title", m["t"][1], None, None))
        elif m["d"] and out and out[-1][0] == "title" and not any(points.values()):
            out.append(("date", s, None, None))
        elif m["2"]:
            flush()
            out.append(("h2", m["2"][1], None, None))
        elif m["r"] or m["q"]:
            flush()
            p, group = (D._ROW, []) if m["r"] else (D._QUOTE, [])
            i -= 1
            while i < len(rest) and re.match(p, rest[i]) and (m["r"] or not re.match(D._ROW, rest[i])):
                group.append(rest[i])
                i += 1
            if m["r"]:
                out.append(("table", None, None, [[c.strip() for c in y.strip().strip("|").split("|")] for y in group if not re.match(D._SEPARATOR, y)]))
            else:
                out.append(("quote", " ".join(y for y in (re.match(p, g)[1].strip() for g in group) if y), None, None))
        else:
            kinds = [("appendix_head", s.startswith(D.ENCLOSURES)), ("signature", s.startswith(D.SIGNED)), ("prosba_head", s.startswith(D.REQUESTS)), ("prosba_tail", re.match(D._REQUEST_TAIL, x)), ("minihead", s.startswith(D.MINI_HEADS)), ("subhead", re.match(D._SUBHEAD, x) and len(s) <= 90)]
            k = next((k for k, ok in kinds if ok), None)
            if k is None and (m["n"] or m["b"]):
                points["numlist" if m["n"] else "bullet"].append((m["n"] or m["b"])[1])
                continue
            flush()
            if k is None:
                k = "source" if out and out[-1][0] == "quote" and re.match(D.SOURCES, s) and len(s) <= 160 else "para"
            out.append((k, s, None, None))
    flush()
    return out


def test_papers_equal_a_plain_reading(spark):
    pool = ["", "", " ", "# Жалоба ", "01.02.2026", "## Раздел", "| а | б |", "|---|:-:|", "> цитата", ">  и ещё", ">", "Постановление № 5", "1. раз", "2) два", "- три", "— четыре", "проза", "А. Довод", "Приложение:", "Представитель\tИванов", "Представитель по доверенности   Пётр", "ПРОШУ:", "Ответчик просит суд:", "Суть спора", "x\x00y", "Пункт 5. и проза"]
    r = random.Random(8)
    texts = ["", "проза", "шапка\nещё\n\n# Т\n01.02.2026\n02.02.2026\r\nабзац"]
    for _ in range(200):
        some = r.sample(pool, r.randint(3, 12))
        texts.append("\n".join(r.choice(some) for _ in range(r.randint(1, 25))))
    got: dict = {}
    for x in D.paper_blocks(spark.createDataFrame(list(enumerate(texts)), "path long, text string")).orderBy("path", "block").collect():
        got.setdefault(x.path, []).append((x.type, x.text, x["items"], x.rows))
    assert {i: got.get(i, []) for i in range(len(texts))} == {i: plain(t) for i, t in enumerate(texts)}


def test_signatures(spark):
    text = "# Т\nПредставитель\tИванов И.\nПредставитель по доверенности   Пётр П.\nПредставитель"
    got = [(x.role, x.name) for x in D.paper_blocks(spark.createDataFrame([(1, text)], "path long, text string")).where("type = 'signature'").orderBy("block").collect()]
    assert got == [("Представитель", "Иванов И."), ("Представитель по доверенности", "Пётр П."), ("Представитель", "")]
