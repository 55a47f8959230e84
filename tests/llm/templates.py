"""Whole page layouts that no composed page has: written by hand, with the article's text beside each page."""

import re

TEMPLATES = ["article_table", "table_layout", "neutral_divs", "unclosed_svg", "stray_apostrophe", "neutral_comments", "lists_and_figures", "news_semantic", "short_beside_aside", "short_beside_div", "long_thread"]


def make_page(name, rng, words):
    def phrase(low, high):
        return " ".join(rng.choice(words, int(rng.integers(low, high))))

    def para(low=2, high=6):
        return " ".join(phrase(5, 16).capitalize() + "." for _ in range(int(rng.integers(low, high))))

    def paras(low, high):
        return "".join(f"<p>{para()}</p>" for _ in range(int(rng.integers(low, high))))

    links = lambda n: "".join(f'<li><a href="/{i}">{phrase(1, 3)}</a></li>' for i in range(n))
    head = f"<h1>{phrase(3, 8)}</h1>"
    foot = f"<p>&copy; 2022 {phrase(2, 4)}. All rights reserved.</p>"
    if name == "article_table":
        rows = "".join(f"<tr><td>{phrase(1, 3)}</td><td>{int(rng.integers(1, 999))}</td><td>{phrase(1, 4)}</td></tr>" for _ in range(int(rng.integers(3, 9))))
        body = f"{head}{paras(2, 5)}<table><tr><th>{phrase(1, 2)}</th><th>{phrase(1, 2)}</th><th>{phrase(1, 2)}</th></tr>{rows}</table>{paras(1, 4)}"
        page = f"<header><p>{phrase(2, 4)}</p></header><nav><ul>{links(6)}</ul></nav><article>{body}</article><footer>{foot}</footer>"
    elif name == "table_layout":
        body = f"{head}{paras(3, 8)}"
        page = f'<table width="100%"><tr><td colspan="3"><b>{phrase(2, 4)}</b></td></tr><tr><td valign="top"><ul>{links(7)}</ul></td><td valign="top">{body}</td><td><b>{phrase(1, 3)}</b><br><a href="/x">{phrase(2, 5)}</a><br><a href="/y">{phrase(2, 5)}</a></td></tr><tr><td colspan="3">{foot}</td></tr></table>'
    elif name == "neutral_divs":
        body = f"{head}{paras(3, 9)}"
        page = f'<div class="a1"><div class="k2"><a href="/">{phrase(1, 3)}</a> <a href="/b">{phrase(1, 3)}</a> <a href="/c">{phrase(1, 3)}</a></div><div class="k3"><div class="k4">{body}</div><div class="k5"><h3>{phrase(1, 3)}</h3><p>{phrase(6, 14).capitalize()}.</p></div></div><div class="k6">&copy; {phrase(2, 5)}.</div></div>'
    elif name == "unclosed_svg":
        body = f'{head}{paras(1, 3)}<svg width="4"><path d="M0 0h4">{paras(2, 5)}'
        page = f'<div class="top"><ul>{links(5)}</ul></div><article>{body}</article><div class="low">{foot}</div>'
    elif name == "stray_apostrophe":
        body = f"{head}<p title=it's>{para()}</p>{paras(2, 6)}"
        page = f"<nav><ul>{links(5)}</ul></nav><main>{body}</main><p class=x'y>&copy; {phrase(2, 4)}</p>"
    elif name == "neutral_comments":
        body = f"{head}{paras(4, 9)}"
        said = "".join(f'<div class="q"><b>{phrase(1, 2)}</b><p>{para(1, 3)}</p><a href="#">Reply</a></div>' for _ in range(int(rng.integers(2, 5))))
        page = f'<div><ul>{links(6)}</ul></div><div class="m">{body}</div><div class="n"><h3>Comments</h3>{said}</div><div>{foot}</div>'
    elif name == "lists_and_figures":
        items = "".join(f"<li>{phrase(3, 10)}</li>" for _ in range(int(rng.integers(3, 8))))
        body = f'{head}{paras(1, 4)}<ul>{items}</ul><figure><img src="a.png"><figcaption>{phrase(4, 9)}</figcaption></figure><h2>{phrase(2, 5)}</h2>{paras(1, 4)}<blockquote><p>{para(1, 3)}</p></blockquote>{paras(1, 3)}'
        page = f'<div id="w"><div id="h"><h2>{phrase(1, 3)}</h2></div><div id="n"><ul>{links(5)}</ul></div><div id="c"><div>{body}</div></div><div id="f">{foot}</div></div>'
    elif name in ("short_beside_aside", "short_beside_div"):
        body = f"{head}<p>{para(1, 2)}</p>"
        main, side = ("article", "aside") if name == "short_beside_aside" else ('div class="p1"', 'div class="p2"')
        page = f"<{main}>{body}</{main.split()[0]}><{side}><h3>{phrase(1, 3)}</h3>{paras(2, 3)}</{side.split()[0]}>"
    elif name == "long_thread":
        body = f"{head}{paras(3, 7)}"
        n = int(rng.integers(5, 20))
        said = "".join(f'<div class="z"><p>{phrase(1, 3)}</p><p>{para(1, 4)}</p></div>' for _ in range(n))
        page = f'<div class="x">{body}</div><div class="y"><h2>{n} comments</h2>{said}</div>'
    else:
        body = f"{head}<p>{phrase(2, 4)}</p>{paras(3, 9)}"
        page = f'<div class="cookie">We use cookies. {para(1, 2)} <button>OK</button></div><header><a href="/">{phrase(1, 3)}</a><form><input><button>Search</button></form></header><nav>{" | ".join(f"<a href=/>{phrase(1, 2)}</a>" for _ in range(5))}</nav><main><article>{body}</article><aside><h2>Related</h2><ul>{links(4)}</ul></aside></main><footer>{foot}</footer>'
    text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", body)).strip()
    return f"<!doctype html><html><head><title>{phrase(2, 5)}</title></head><body>{page}</body></html>", text
