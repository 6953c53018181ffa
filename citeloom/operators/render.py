"""Articles in HTML with their citations shown: marks in the text, panels behind them, a banner, linked data.

A page is rewritten as a whole and needs no other, so pages and their citations meet by one join and
go to Python in Arrow batches.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.labels import author_label, meta_line, strain_label, verification_label

CSS = ".cl-mark{border-bottom:2px solid #888;cursor:pointer}.cl-badge{cursor:pointer}.cl-panel{display:none}.cl-open{display:block}"
JS = "function clToggle(e){var p=document.getElementById('cl-panel-'+e.dataset.cite);if(p)p.classList.toggle('cl-open')}"
_OWN = ("cl-mark", "cl-wrap")
_GONE = ("cl-badge", "cl-panel", "cl-banner")


def locate(body: str, target: str) -> tuple[int, int] | None:
    """Where a passage stands in markup: as it is, escaped, over other white space, over tags, or by its ends."""
    for form in (target, html.escape(target)):
        if form and (at := body.find(form)) >= 0:
            return at, at + len(form)
    words = target.split()
    if len(words) >= 3:
        for gap in (r"\s+", r"(?:\s*<[^>]+>\s*)*\s+"):
            if found := re.search(gap.join(map(re.escape, words)), body):
                return found.span()
    if len(words) >= 4 and (at := body.find(" ".join(words[:4]))) >= 0:
        near = body[at : at + len(target) + 200]
        for cut in range(min(4, len(words) - 4)):
            # The last words, one fewer each time, may have been altered.
            last = " ".join(words[-(4 - cut) :] if not cut else words[-(4 - cut) : -cut])
            end = near.find(last) if last else -1
            if end >= 0 and abs(end + len(last) - len(target)) < 0.3 * len(target):
                return at, at + end + len(last)
    return None


def _element(page: str, at: int) -> tuple[int, int, int] | None:
    """(end of the opening tag, start of its closing tag, end) of the element that begins at at."""
    opening = re.compile(r"<([a-z0-9]+)\b[^>]*>", re.I).match(page, at)
    if not opening:
        return None
    depth = 0
    for m in re.finditer(rf"<(/?){opening[1]}\b[^>]*>", page[at:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return opening.end(), at + m.start(), at + m.end()
    return None


def cleaned(page: str) -> str:
    """Without what render() adds: marks are unwrapped, panels, badges, banner, style, script and data go."""
    page = re.sub(r'(?s)<(style|script) [^>]*data-cl[^>]*>.*?</\1>\n?', "", page)
    for names, keep in ((_GONE, False), (_OWN, True)):
        start = re.compile(rf'<[a-z]+ class="(?:{"|".join(names)})\b')
        at = 0
        while found := start.search(page, at):
            part = _element(page, found.start())
            if part is None:
                at = found.end()
                continue
            inner, close, end = part
            page = page[: found.start()] + (page[inner:close] if keep else "") + page[end:]
            at = found.start()
    return page


def _panel(c: dict) -> str:
    shown = [f'<strong>{c["label"]}</strong>', html.escape(c["title"] or ""), c["meta"] or "", f'<blockquote>{html.escape(c["text_exact"])}</blockquote>']
    if c["url"]:
        shown.append(f'<a href="{html.escape(c["url"])}" rel="noopener">Source</a>')
    shown += [f'<span class="cl-{kind}">{html.escape(label)}</span>' for kind, label in ((c["verify_kind"], c["verify_label"]), (c["strain_kind"], c["strain_label"])) if label]
    return f'<div class="cl-panel" id="cl-panel-{html.escape(c["id"])}">{" ".join(s for s in shown if s)}<code>{c["hash"] or ""}</code></div>'


def render(page: str, cites: list[dict]) -> str:
    """page with cites: those of one passage share a mark with a badge each; passages not found have panels only."""
    page = cleaned(page)
    if not cites:
        return page
    groups: dict[str, list[dict]] = {}
    for c in sorted(cites, key=lambda c: (c["position"] or 0, c["id"])):
        groups.setdefault(c["text_exact"], []).append(c)
    begin = re.search(r"(?i)<body[^>]*>", page)
    head, body = (page[: begin.end()], page[begin.end() :]) if begin else ("", page)
    for text, members in sorted(groups.items(), key=lambda g: -(g[1][0]["position"] or 0)):
        if place := locate(body, text):
            ids = [html.escape(c["id"]) for c in members]
            badges = "".join(f'<sup class="cl-badge" data-cite="{i}" onclick="clToggle(this)">c</sup>' for i in ids)
            body = f'{body[: place[0]]}<span class="cl-mark" data-cite="{ids[0]}" data-cites="{",".join(ids)}" onclick="clToggle(this)">{body[place[0] : place[1]]}</span>{badges}{body[place[1] :]}'
    ordered = [c for g in groups.values() for c in g]
    data = json.dumps([json.loads(c["record"]) for c in ordered], ensure_ascii=False).replace("</", "<\\/")
    tail = "".join([*map(_panel, ordered), f'<script data-cl type="application/ld+json">{data}</script>', f"<script data-cl async>{JS}</script>"])
    banner = f'<div class="cl-banner">{len(ordered)} verifiable citations</div>'
    style = f"<style data-cl media=\"all\">{CSS}</style>\n"
    close = re.search(r"(?i)</body\s*>", body)
    body = body[: close.start()] + tail + body[close.start() :] if close else body + tail
    if not begin:
        return f"<!doctype html><html><head>{style}</head><body>{banner}{body}</body></html>"
    end = re.search(r"(?i)</head\s*>", head)
    head = head[: end.start()] + style + head[end.start() :] if end else style + head
    return head + banner + body


FIELDS = ("id", "text_exact", "position", "hash", "title", "url", "label", "meta", "verify_kind", "verify_label", "strain_kind", "strain_label", "record")


def shown(record: Column, badge: Column | None = None, band: Column | None = None, position: Column | None = None) -> Column:
    """What render() needs of a citation row (version, id, source, target ...), with its record as JSON."""
    none = F.lit(None).cast("string")
    v, s = (verification_label(badge), strain_label(band)) if badge is not None and band is not None else (verification_label(badge) if badge is not None else None, strain_label(band) if band is not None else None)
    part = lambda x, k: none if x is None else x[k]
    return F.struct(
        F.col("id"), F.col("target.text_exact").alias("text_exact"), (position if position is not None else F.lit(0)).cast("int").alias("position"), F.col("target.hash").alias("hash"), F.col("source.title").alias("title"), F.coalesce("target.fragment_url", "source.url").alias("url"),
        author_label("source.authors", "source.title", "source.year").alias("label"), meta_line("source.authors", "source.venue", "source.year", "source.source_type").alias("meta"),
        part(v, "kind").alias("verify_kind"), part(v, "label").alias("verify_label"), part(s, "kind").alias("strain_kind"), part(s, "label").alias("strain_label"), record.alias("record"),
    )


def rendered(pages: DataFrame, cites: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, output, located): pages with their citations (doc, c: shown()), and how many of these have a mark.

    Existing marks are removed first, so rendering again renews a page.
    """
    lists = cites.groupBy(doc).agg(F.collect_list("c").alias("__c"))  # a page's own citations
    rows = pages.select(doc, F.col(page).alias("__p")).join(lists, doc, "left").select(doc, "__p", F.to_json("__c").alias("__c"))
    kind = pages.schema[doc].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out, n = [], []
            for p, c in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                own = [dict.fromkeys(FIELDS) | x for x in json.loads(c)] if c else []
                text = None if p is None else render(p, own)
                out.append(text)
                n.append(0 if text is None else sum(len(m[1].split(",")) for m in re.finditer(r'data-cites="([^"]*)"', text)))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=[doc, "output", "located"])

    return rows.mapInArrow(run, f"`{doc}` {kind}, output string, located int")
