"""Parsers: sentences, wiki markers, HTML, escapes and model responses."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Sentences: a text is parted after a full stop, question or exclamation mark and white space."""
    parts = F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+")
    # A function of two parameters would be given each part's index: F.trim by itself takes that as what to trim.
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


# The markers of the article format.
ARTICLE, SECTION, PARAGRAPH, NEWLINE = "_START_ARTICLE_", "_START_SECTION_", "_START_PARAGRAPH_", "_NEWLINE_"
ARTICLE_SCHEMA = "title string, abstract array<string>, sections array<struct<title: string, paragraphs: array<string>>>"


def parse_article(text: str | None) -> dict:
    """Title, abstract (what comes before the first section) and sections of a marked article."""
    out: dict = {"title": "", "abstract": [], "sections": []}
    marks = re.split(f"({ARTICLE}|{SECTION}|{PARAGRAPH})", text or "")
    for mark, body in zip(marks[1::2], marks[2::2]):
        body = body.strip()
        if mark == ARTICLE:
            out["title"] = body
        elif mark == SECTION:
            out["sections"].append({"title": body, "paragraphs": []})
        else:
            into = out["sections"][-1]["paragraphs"] if out["sections"] else out["abstract"]
            into += [p.strip() for p in body.split(NEWLINE) if p.strip()]
    return out


def article(text: Column) -> Column:
    """A marked article's parts as a struct."""

    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_article(t) for t in texts], columns=["title", "abstract", "sections"])

    return F.pandas_udf(parse, ARTICLE_SCHEMA)(text)


def article_pair(parsed: Column) -> Column:
    """(anchor, positive): title and first section's title, and that section's first paragraph; else the title and the abstract's first."""
    first = F.get(parsed["sections"], F.lit(0))
    paragraph = F.get(first["paragraphs"], F.lit(0))
    return F.struct(
        F.concat_ws(" ", parsed["title"], F.when(paragraph.isNotNull(), first["title"])).alias("anchor"),
        F.coalesce(paragraph, F.get(parsed["abstract"], F.lit(0))).alias("positive"),
    )


def unescaped(text: str | None) -> str | None:
    """Backslash escapes decoded; what is no escape stays, in any script."""
    plain = {"n": "\n", "t": "\t", "r": "\r"}

    def one(m: re.Match) -> str:
        code = m[0][1:]
        return chr(int(code[1:], 16)) if code[0] in "ux" else plain.get(code, code)

    return None if text is None else re.sub(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[ntr\\'\"])", one, text)


def unescape(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(unescaped)

    return F.pandas_udf(run, "string")(text)


class _Markdown(HTMLParser):
    """Markdown-like text of a page's main part."""

    _SKIP = {"script", "style", "nav", "footer", "aside", "noscript", "template"}
    _BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "br", "tr", "blockquote", "pre", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.out, self.skipped, self.tables, self.in_title = "", [], 0, 0, False

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self.skipped += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "table":
            self.tables += 1
            self.out.append("\n[table]\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in self._BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "table":
            self.tables = max(0, self.tables - 1)
        elif tag in self._BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skipped and not self.tables:
            self.out.append(re.sub(r"\s+", " ", data))


PAGE_SCHEMA = "title string, text string, sections array<struct<heading: string, body: string>>"


def parse_page(html: str | None) -> dict:
    """Title, text and sections of a page: of its main part, else its article, else its body, else all of it."""
    html = html or ""
    whole = _Markdown()
    whole.feed(html)
    part = next((m[0] for tag in ("main", "article", "body") if (m := re.search(rf"(?is)<{tag}\b.*?</{tag}\s*>", html))), html)
    parser = _Markdown()
    parser.feed(part)
    text = re.sub(r"\n[ \t]*(?:\n[ \t]*)+", "\n\n", "".join(parser.out)).strip()
    heads = list(re.finditer(r"(?m)^#{1,6} (.*)$", text))
    ends = [m.start() for m in heads[1:]] + [len(text)]
    sections = [{"heading": m[1].strip(), "body": text[m.end() : e].strip()} for m, e in zip(heads, ends)]
    title = whole.title.strip() or (sections[0]["heading"] if sections else "")
    return {"title": title, "text": text, "sections": sections}


def page(html: Column) -> Column:
    """A page's parts as a struct."""

    def parse(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h) for h in htmls], columns=["title", "text", "sections"])

    return F.pandas_udf(parse, PAGE_SCHEMA)(html)


RESPONSE = "struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>, usageMetadata: struct<promptTokenCount: bigint, candidatesTokenCount: bigint>>"


def response_text(response: Column) -> Column:
    """Text of a nested model response in JSON; null where it is malformed."""
    return F.get(F.get(F.from_json(response, RESPONSE)["candidates"], F.lit(0))["content"]["parts"], F.lit(0))["text"]


def response_tokens(response: Column) -> Column:
    return F.coalesce(F.from_json(response, RESPONSE)["usageMetadata"]["promptTokenCount"], F.lit(0))


# The fields that a judge's or a translator's answer must have.
CRITIQUE, TRANSLATION = "critique string, score int", "translation string"
VERDICT = "query_translation string, doc_translation string, key_term_lost boolean, pair_relevance string, retrieval_risk string, note string"


def checked_verdict(answer: Column) -> Column:
    """A verdict's struct with error: null fields or a malformed answer are errors, not rows lost."""
    v = F.from_json(answer, VERDICT)
    return F.struct(v["key_term_lost"].alias("key_term_lost"), v["retrieval_risk"].alias("retrieval_risk"), (v["key_term_lost"].isNull() | v["retrieval_risk"].isNull()).alias("error"))
