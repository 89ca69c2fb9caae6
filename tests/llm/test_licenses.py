from paraweft.llm.licenses import TEMPLATES, bigrams, scan, triggers, words_of


def plain(text):
    units = text.split("\n")
    out = {}
    import re

    longer = {u for u in [*re.split(r"\n\s*\n", text), text] if "\n" in u}
    for line, unit in [*enumerate(units), *((-1, u) for u in longer)]:
        for name, t in TEMPLATES:
            a, b = bigrams(unit), bigrams(t)
            if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                out.setdefault(name, []).append((line, 2 * len(a & b) / (len(a) + len(b))))
    return {k: (max(d for _, d in v), min([n for n, _ in v if n >= 0], default=-1)) for k, v in out.items()}


def test_scan_equals_trying_everything(docs_of):
    mit = max((t for n, t in TEMPLATES if n == "MIT"), key=len)
    half = " ".join(mit.split()[:40])
    texts = ["Released under the MIT License.", "x\n\nreleased UNDER the mit license\nmore", mit.replace(", ", ",\n", 3), "Intro\n\n" + mit + "\n\nOutro", half, "The license is mit", "This work is licensed under the GNU General Public License, version 2.", "under the by", None, "", "word", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0."]
    got = {}
    for r in scan(docs_of(texts)).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.dice, r.first_line)
    assert got == {k: plain(t) for k, t in enumerate(texts) if t and plain(t)}


def everywhere(text):
    """The best coefficient of each license over all windows of its templates' lengths."""
    out = {}
    w = words_of(text)
    for name, t in TEMPLATES:
        b, m = bigrams(t), len(words_of(t))
        for i in range(max(len(w) - m, 0) + 1):
            a = set(f"{x} {y}" for x, y in zip(w[i : i + m], w[i + 1 : i + m]))
            out[name] = max(out.get(name, 0), 2 * len(a & b) / (len(a) + len(b)) if a else 0)
    return out


def test_notices_within_longer_text(docs_of):
    code = "def main():\n    return run(parse(argv))\n" * 40
    texts = [f"Copyright (c) 2020 Someone. {t} All other things are said elsewhere in this long line. {code}" for _, t in TEMPLATES]
    texts += ["/*\n" + "\n".join(" * " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9)) + "\n */\n" + code for _, t in TEMPLATES]
    rows = {}
    for r in scan(docs_of(texts)).collect():
        rows.setdefault(r.doc_id, {})[r.license] = r.dice
    for k, text in enumerate(texts):
        name = TEMPLATES[k % len(TEMPLATES)][0]
        best = everywhere(text)
        assert rows[k][name] == 1.0
        assert set(rows[k]) <= {n for n, d in best.items() if d >= 0.8}


def test_the_same_notice_a_hundred_times(docs_of):
    (row,) = scan(docs_of(["Released under the MIT License. " * 100])).collect()
    assert row.license == "MIT" and row.dice == 1.0 and row.passages == 2 and row.first_line == 0


def test_a_match_holds_a_trigger():
    for _, t in TEMPLATES:
        grams, words = bigrams(t), triggers(bigrams(t), 0.8)
        left = {g for g in grams if not set(g.split()) & set(words)}
        assert len(left) < 0.8 / 1.2 * len(grams)


def test_edges(docs_of):
    assert scan(docs_of([])).count() == 0
    assert scan(docs_of(["Released under the MIT License."]), templates=[]).count() == 0
    twice = docs_of([(1, "Released under the MIT License.", None, None)] * 2)
    assert scan(twice).count() == 2
