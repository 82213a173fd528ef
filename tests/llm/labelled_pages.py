"""Pages with their main text marked by hand: {{...}} encloses what belongs to it. Twenty-eight layouts, each with short, middle and long paragraphs."""

import re

SENTENCES = [
    "The river rose by two metres in the night and the lower road was closed.", "Nobody in the village had seen such water since the old bridge was built.", "By noon the fire brigade had carried forty people to the school on the hill.",
    "Farmers led their animals to higher ground while the rain went on.", "A spokesman for the district said that the dam would hold.", "In the evening the wind turned and the first stars came out over the valley.",
    "Repairs to the railway will take until spring, the company announced.", "Most of the houses have been dry for a week, yet the cellars smell of mud.", "Schools open again on Monday, and the market returns to its usual place.",
    "The mayor thanked everyone who had helped with pumps, boats and bread.",
]
NAV = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "Contact"))
LINKS = "".join(f'<li><a href="/s/{i}">Another story of the day, number {i}</a></li>' for i in range(6))
READERS = "I was there and it was worse than the paper says. "
ASIDE = "Opening hours of our office are nine to five, on Saturdays until noon, and by agreement. " * 6
SHORT = "<p>{{Then it rained.}}</p><p>{{Nobody slept.}}</p><p>{{The dam held.}}</p>"

LAYOUTS = {
    "article": f'<header><h1>The Daily</h1></header><nav><ul>{NAV}</ul></nav><div class="ad">Buy boats now, cheap.</div><article><h1>{{{{T}}}}</h1>P1P2P3P4</article><footer>&copy; The Daily, all rights reserved.</footer>',
    "divs": f'<div id="page"><div id="menu"><ul>{NAV}</ul></div><div id="content"><h1>{{{{T}}}}</h1>P1P2P3</div><div id="foot">Imprint and terms</div></div>',
    "table": f'<table><tr><td><ul>{NAV}</ul></td><td><h2>{{{{T}}}}</h2>P1P2P3</td></tr><tr><td><a href="/i">Imprint</a></td></tr></table>',
    "notice-board": f'<ul>{NAV}</ul><div class="notice-board"><h1>{{{{T}}}}</h1>P1P2P3</div><div class="footer">Copyright of the notice board</div>',
    "widget-content": f'<nav>{NAV}</nav><div class="widget-content"><h1>{{{{T}}}}</h1>P1P2P3</div>',
    "search-results-page": f'<nav>{NAV}</nav><div id="search-results-page"><div><h1>{{{{T}}}}</h1>P1P2P3P4</div></div><footer>All rights reserved</footer>',
    "header-and-text": f'<div class="header-and-text"><h1>{{{{T}}}}</h1>P1P2</div><div class="links"><ul>{LINKS}</ul></div>',
    "form": f'<form action="/"><input type="hidden" name="state"><div class="menu"><ul>{NAV}</ul></div><div><h1>{{{{T}}}}</h1>P1P2P3</div><div class="footer">Contact us at any time</div></form>',
    "main and aside": f'<div role="banner">The Daily, since 1890</div><main><h1>{{{{T}}}}</h1>P1P2<aside><h3>More</h3><ul>{LINKS}</ul></aside>P3P4</main><footer><ul>{NAV}</ul></footer>',
    "comments": f'<article><h1>{{{{T}}}}</h1>P1P2P3</article><section class="comments"><h3>Comments</h3><article><p>{READERS * 2}</p></article><article><p>{READERS * 3}</p></article><form><label>Your comment</label><textarea></textarea></form></section>',
    "flat": f"<ul>{NAV}</ul><h1>{{{{T}}}}</h1>P1P2P3P4<ul>{LINKS}</ul>",
    "title outside": f'<div class="nav">{NAV}</div><h1>{{{{T}}}}</h1><div class="text">P1P2P3</div><div class="share">Share this</div>',
    "lists": '<div class="topbar"><a href="/">Home</a></div><article><h1>{{T}}</h1>P1<blockquote>P2</blockquote><ul><li>{{ten boats}}</li><li>{{four pumps}}</li></ul><table><tr><th>{{Day}}</th><td>{{Monday}}</td></tr></table>P3</article>',
    "sections": f"<nav>{NAV}</nav><section>P1P2</section><section>P3</section><section>P4</section><footer>The end of the page</footer>",
    "breaks": f'<div class="sidebar"><ul>{LINKS}</ul></div><div class="body"><b>{{{{T}}}}</b><br><br>B1<br><br>B2<br><br>B3</div>',
    "cookies": f'<div class="cookie-banner"><p>We and our partners use cookies to keep this site running and to learn how it is used.</p><button>Accept</button></div><div class="story"><h1>{{{{T}}}}</h1>P1P2P3</div><div class="newsletter"><form><p>Have our best stories sent to you every morning.</p><input></form></div><div class="related"><ul>{LINKS}</ul></div>',
    "broken": f'<div class=nav><ul><li><a href=/>Home<li><a href=/n>News</ul></div><article><h1>{{{{T}}}}</h1><p><b>{{{{T}}}}<br>P1P2P3</article></div><footer>&copy; 2024',
    "long comments inside": f'<article><h1>{{{{T}}}}</h1>P1P2<section class="comments"><p>{READERS * 60}</p><p>{READERS * 60}</p></section></article>',
    "long comments beside": f'<div class="story"><h1>{{{{T}}}}</h1>P1{SHORT}P2P3</div><div id="comments"><p>{READERS * 40}</p><p>{READERS * 50}</p></div>',
    "long aside": f'<article><h1>{{{{T}}}}</h1>P1</article><aside><p>{ASIDE}</p></aside>',
    "long sidebar": f'<div class="sidebar"><p>{ASIDE}</p></div><div class="text"><h1>{{{{T}}}}</h1>P1P2{SHORT}P3</div>',
    "long notice": f'<div class="notice"><p>{ASIDE}</p></div><div class="text"><h2>{{{{T}}}}</h2>P1{SHORT}P2</div>',
    "short ends": f'<div><a href="/">Home</a><a href="/n">News</a></div><div><p>{{{{By our own reporter}}}}</p>P1P2P3<p>{{{{To be continued.}}}}</p></div><ul>{LINKS}</ul>',
    "short middle": f'<ul>{NAV}</ul><div><h1>{{{{T}}}}</h1>P1{SHORT}P2<p>{{{{Ends.}}}}</p></div><ul>{LINKS}</ul>',
    "flat, short ends": f'<ul>{NAV}</ul><h1>{{{{T}}}}</h1><p>{{{{Monday}}}}</p>P1P2P3<p>{{{{Ends.}}}}</p><ul>{LINKS}{NAV}</ul>',
    "teasers": f'<ul>{NAV}</ul><div>P1P2P3P4<p>{{{{Ends.}}}}</p></div><div><ul>{LINKS}</ul><p>More</p><ul>{LINKS}</ul><p>All topics</p><p>A to Z</p></div>',
    "replies": f'<div class="post"><p>{{{{By our own reporter}}}}</p>P1P2</div><ol class="replies"><li>{READERS * 30}</li><li>{READERS * 30}</li></ol>',
    "roles": f'<div role="navigation">{NAV}</div><div role="main"><h1>{{{{T}}}}</h1>P1P2P3</div><div role="complementary"><p>Opening hours of our office: nine to five, on Saturdays until noon.</p></div><div role="contentinfo">Imprint</div>',
}


def pages():
    """(name, html, main text)."""
    for at, (name, layout) in enumerate(LAYOUTS.items()):
        for size in (1, 3, 8):
            html = layout.replace("T}}", SENTENCES[at % 10].split(" and ")[0] + "}}")
            for i in range(1, 5):
                own = " ".join(SENTENCES[(at + i + k) % 10] for k in range(size))
                html = html.replace(f"P{i}", f"<p>{{{{{own}}}}}</p>").replace(f"B{i}", f"{{{{{own}}}}}")
            html = f"<!DOCTYPE html><html><head><title>The Daily</title><style>p{{}}</style></head><body>{html}</body></html>"
            text = " ".join(re.sub("<[^>]*>", "", x) for x in re.findall(r"\{\{(.*?)\}\}", html, re.S))
            yield f"{name} {size}", re.sub(r"\{\{|\}\}", "", html), " ".join(text.split())
