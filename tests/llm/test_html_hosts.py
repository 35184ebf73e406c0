"""Generated hosts: what pages share as furniture goes, what is theirs stays, whatever the pages that a piece of furniture is on."""

import random

from chronoweave.llm import html_template


def test_generated_hosts(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for h in range(12):
        n = rng.randint(2, 7)
        in_article = h % 3 != 0
        # Furniture: a block of one to three texts in a container of its own, on all pages or on two of them at least.
        furniture = []
        for f in range(rng.randint(1, 4)):
            on = set(range(n)) if rng.random() < 0.5 else set(rng.sample(range(n), rng.randint(2, n)))
            texts = [f"host{h} piece{f} line{k}" for k in range(rng.randint(1, 3))]
            furniture.append((on, f"<div class='box{chr(97 + f)}'>{'<hr>'.join(texts)}</div>"))
        place = [rng.randint(0, 3) for _ in furniture]
        for p in range(n):
            own = [" ".join(f"h{h}p{p}b{b}w{k}" for k in range(40)) for b in range(3)]
            blocks = []
            for b in range(4):
                blocks += [html for (on, html), at in zip(furniture, place, strict=True) if at == b and p in on]
                blocks += [f"<p>{own[b]}</p>"] if b < 3 else []
            body = "".join(blocks)
            page = h * 100 + p
            rows.append((page, f"https://site{h}.example/{p}", f"<html><body><nav><ul><li>Home</ul></nav>{f'<article>{body}</article>' if in_article else body}<footer>imprint {p}</footer></body></html>"))
            want[page] = " ".join(own)
    got = {r.page_id: (r.text, r.n_chars) for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
