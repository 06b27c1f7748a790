import random
import re
import time

import pytest

from waymark.llm.html_extraction import Scanner, parse

#: What a tag is, as one expression that may look ahead to the page's end at each tag; a name is never cut short for a quote in it.
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*)>)""", re.S)
PIECES = ["<a ", "<p>", '<div class="x">', "<li>", "</li>", '"', "'", ">", "<", "text ", "<!-- c -->", "<!--", "-->", "</div>", "<!DOCTYPE x>", "<?x", "x='1' ", "/", "é\n", "x" * 1500]


def test_tags_are_those_of_the_expression():
    rng = random.Random(7)
    for _ in range(5000):
        page = "".join(rng.choices(PIECES, k=rng.randrange(1, 40)))
        scanner, at, got = Scanner(page), 0, []
        while (found := scanner.after(at)) is not None:
            got.append(found)
            at = found[1]
        want = [(m.start(), m.end(), m[1] or m[4] or "", m[2] or m[5] or "", m[3] or m[6] or "") for m in TAG.finditer(page)]
        assert got == want, page


@pytest.mark.parametrize("unit", ['<a "', '<a ">', "<a '>\"", "<a", "<head>", "<div>", "<div></p>", "<header>", "<!-", '<a class="', '<svg "', "<li><ul><div>", "<b <"])
def test_broken_pages_cost_their_length(unit):
    start = time.time()
    parse(unit * (400_000 // len(unit)))
    assert time.time() - start < 20
