"""Schedules and rosters in HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laddersmith.functions.names import SITE_ON, header_of_file, placeholder, team_name
from laddersmith.session import ship

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Fixed value: a score as schedule pages print it.
_SCORE = re.compile(r"(\d+)\s*[:\-–—]\s*(\d+)")


class Element:
    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += [k for k in reversed(x.kids) if isinstance(k, Element)]

    def text(self) -> str:
        todo, out = [self], []
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.kids)
        return " ".join("".join(out).split())

    def words(self) -> str:
        """The texts inside, stripped and joined by a space."""
        todo, out = [self], []
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            else:
                todo += reversed(x.kids)
        return " ".join(out)

    def first(self, outer: str, inner: str) -> Element | None:
        """The first element of class ``inner`` inside one of class ``outer``."""
        return next((y for x in self.find(outer) for y in x.find(inner)), None)

    def find(self, *classes: str, tag: str | None = None) -> list[Element]:
        return [x for x in self.walk() if x is not self and (tag is None or x.tag == tag) and set(classes) <= x.classes]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("root", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, dict(attrs), self.now)
        self.now.kids.append(e)
        if tag not in _VOID:
            self.now = e

    def handle_endtag(self, tag):
        x = self.now
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.now = x.parent

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.kids.append(data)


def dom(page: str | None) -> Element:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, html) of all .html and .htm files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(F.lower("path").rlike(r"\.html?$"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("html"))


def _time(s: str | None) -> str | None:
    """An ISO time, also for seconds since 1970."""
    s = (s or "").strip()
    if s.isdigit() and len(s) > 8:
        return pd.Timestamp(int(s), unit="s").isoformat()
    try:
        return s if s and not pd.isna(pd.Timestamp(s)) else None
    except ValueError:
        return None


def schedule_rows(page: str) -> list[tuple]:
    """(time, home, home score, away, away score) of each match block with time, score and both teams."""
    out = []
    for m in dom(page).walk():
        if m.tag != "div" or "schedule-match" not in (m.attrs.get("class") or ""):
            continue
        time = _time(m.attrs.get("data-iso-datetime") or m.attrs.get("data-datetime"))
        shown = (m.find("static-scores") or m.find("visible-print-inline") or [None])[0]
        score = _SCORE.search(shown.words()) if shown is not None else None
        sides = [m.first(f"{a}-team", "team-display") or m.first(f"{b}-team", "team-display") for a, b in (("home", "left"), ("away", "right"))]
        names = [team_name(x.words()) if x is not None else "" for x in sides]
        if time and score and all(names):
            out.append((time, names[0], str(int(score[1])), names[1], str(int(score[2]))))
    return out


def read_schedules(files: DataFrame) -> DataFrame:
    """Raw games of schedule pages: filename, time, team1, score1, team2, score2."""
    ship(files.sparkSession)

    def run(frames):
        for f in frames:
            rows = [(n, *r) for n, h in zip(f["filename"], f["html"], strict=True) for r in schedule_rows(h)]
            yield pd.DataFrame(rows, columns=["filename", "time", "team1", "score1", "team2", "score2"])

    return files.select("filename", "html").mapInPandas(run, "filename string, time string, team1 string, score1 string, team2 string, score2 string")


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(n for n in names if n))


def guest_titles(root: Element) -> list[str]:
    """Titles of the circles of a guest list, with repetitions."""
    return [x.attrs["title"] for x in root.find("guest-list-circle", tag="div") if x.attrs.get("title")]


def member_names(team: Element) -> list[str]:
    """The name cells of a team's member list."""
    cells = [c for box in team.find("team-members-container") for li in box.find("list-group-item", tag="li") for c in li.find("col-md-4")[:1]]
    return [x for x in (c.words() for c in cells) if x]


def listed_teams(root: Element) -> list[Element]:
    return [t for ul in root.find("team-list", tag="ul") for t in ul.find("team", tag="li")]


def row_names(root: Element) -> list[str]:
    out = []
    for row in root.find("roster-row"):
        span = next((s.text() for s in row.walk() if s.tag == "span" and s.text()), "")
        out.append(span or next(((i.attrs.get("title") or "").strip() for i in row.walk() if i.tag == "img" and i.attrs.get("title")), ""))
    return _unique(out)


def roster_of(page: str) -> list[str]:
    """Players of a page by the layout that it has: guest list, roster rows, first team of a team list; else the titles of its images."""
    root = dom(page)
    if root.find("guest-list-circle"):
        return guest_titles(root)
    if root.find("roster-row"):
        return row_names(root)
    if teams := listed_teams(root):
        return _unique(member_names(teams[0]))
    return _unique([(x.attrs.get("title") or "").strip() for x in root.walk() if x.tag == "img"])


#: A division whose teams are left out, and lines of a team's list that are no players.
OPEN_DRAFT, NO_PLAYERS = "open draft spring25", {"open draft spring25", "wtnb", "draft", "social", "add"}


def registration_teams(page: str, filename: str) -> list[tuple[str, list[str]]]:
    """(team, players) of each team of a registrations page; those of the open draft are skipped."""
    out = []
    for t in listed_teams(dom(page)):
        if any(x.words().lower() == OPEN_DRAFT for x in t.walk() if x is not t):
            continue
        head = (t.find("reg-team-name") or t.find("list-group-item-heading") or [None])[0]
        name = head.words() if head is not None else header_of_file(filename)
        players = [p for p in member_names(t) if not placeholder(p) and p.lower() not in NO_PLAYERS and p != name]
        out.append((name, _unique(players)))
    return out


def read_rosters(files: DataFrame, registrations: bool = False) -> DataFrame:
    """(team, slot, player, filename) of roster pages; the team is the page's header, or the file's name. A page that lists several teams gives each, with ``registrations``."""
    ship(files.sparkSession)

    def run(frames):
        for f in frames:
            rows = []
            for n, h in zip(f["filename"], f["html"], strict=True):
                teams = registration_teams(h, n) if registrations else [(header_text(h) or header_of_file(n), roster_of(h))]
                rows += [(t, i, p, n) for t, ps in teams for i, p in enumerate(ps)]
            yield pd.DataFrame(rows, columns=["team", "slot", "player", "filename"])

    return files.select("filename", "html").mapInPandas(run, "team string, slot long, player string, filename string")


def header_text(page: str) -> str | None:
    """The first h1's text, else the title without the site's suffix."""
    root = dom(page)
    h1 = next((x.words() for x in root.walk() if x.tag == "h1"), "")
    title = next((x.words() for x in root.walk() if x.tag == "title"), "")
    return h1 or re.split(SITE_ON, title, maxsplit=1)[0].strip() or None


def header(c: Column) -> Column:
    """The same for well-formed pages, with built-in functions."""
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?:\s*<[^>]*>\s*)+", " "))
    h1, title = inner("h1"), F.trim(F.split(inner("title"), SITE_ON, 2)[0])
    return F.when(h1 != "", h1).when(title != "", title)


def titles(c: Column) -> Column:
    """All title attributes of images, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r'(?i)<img\b[^>]*\btitle="([^"]+)"'), 1))
