"""Price lists from landed shop pages, JSON documents and text records, and other landed JSON."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_name, price_digits, price_scale, valid_price_row

class _Rows(HTMLParser):
    """Cells of a page's rows: elements `cell` inside elements `row`, inside elements `table` of a class if they are named; an attribute's value or the text, a line for each paragraph.

    In place of a class, id^=x stands for an attribute that begins with x and style*=x for one that contains it; text~=x and
    header~=a,b choose a table by what it holds, see _HeldRows.
    """

    def __init__(self, table: str, klass: str, row: str, cell: str, attribute: str):
        super().__init__(convert_charrefs=True)
        self.want, self.klass, self.row, self.cell, self.attribute = table, klass, row, cell, attribute
        self.rows: list[list[str]] = []
        self.depth, self.inside, self.into = 0, not table, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == self.want:
            if self.depth or self._named(a):
                self.depth += 1
                self.inside = True
        if not self.inside:
            return
        if tag == self.row:
            self.rows.append([])
            self.into = None
        if tag in ("p", "br", "div") and self.into is not None and not self.attribute:
            self.into[0] += "\n"
        if tag in self.cell.split("|") and self.rows:
            self.into = [a.get(self.attribute) or ""] if self.attribute else [""]
            self.rows[-1].append(self.into)

    def _named(self, a: dict) -> bool:
        for sign, holds in (("^=", str.startswith), ("*=", str.__contains__)):
            if sign in self.klass:
                name, value = self.klass.split(sign, 1)
                return holds(a.get(name) or "", value)
        return not self.klass or self.klass in (a.get("class") or "").split()

    def handle_endtag(self, tag):
        if tag == self.want and self.depth:
            self.depth -= 1
            self.inside = bool(self.depth)
        if tag in self.cell.split("|"):
            self.into = None

    def handle_data(self, data):
        if self.into is not None and not self.attribute:
            self.into[0] += data


class _HeldRows(HTMLParser):
    """Rows of the innermost table, the first of several, that holds what is asked: text~=x a text, header~=a,b columns in its first row, case aside."""

    def __init__(self, table: str, holds: str, row: str, cell: str, attribute: str):
        super().__init__(convert_charrefs=True)
        self.kind, _, what = holds.partition("~=")
        self.what = [w.strip().casefold() for w in (what.split(",") if self.kind == "header" else [what])]
        self.want, self.parts = table or "table", (row, cell, attribute)
        self.open: list[tuple[_Rows, list[str], list[list[str]]]] = []  # of each open table: its rows, its text, its first row
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == self.want:
            self.open.append((_Rows("", "", *self.parts), [], []))
            return
        if self.open:
            rows, _, first = self.open[-1]
            rows.handle_starttag(tag, attrs)
            if tag in ("th", "td") and len(rows.rows) <= 1:
                first.append([])

    def handle_endtag(self, tag):
        if tag == self.want:
            self._end()
        elif self.open:
            self.open[-1][0].handle_endtag(tag)

    def handle_data(self, data):
        for _, text, _ in self.open:
            text.append(data)
        if self.open:
            rows, _, first = self.open[-1]
            rows.handle_data(data)
            if first and len(rows.rows) <= 1:
                first[-1].append(data)

    def _end(self):
        if not self.open:
            return
        rows, text, first = self.open.pop()
        columns = {" ".join("".join(c).split()).casefold() for c in first}
        whole = " ".join("".join(text).split()).casefold()
        if self.rows is None and (all(w in columns for w in self.what) if self.kind == "header" else self.what[0] in whole):
            self.rows = rows.rows

    def close(self):
        super().close()
        while self.open:
            self._end()
        self.rows = self.rows or []


def rows_of(page: str | None, table: str, klass: str, row: str, cell: str, attribute: str, lines: str = "") -> list[list[str]]:
    """Rows of cells. lines: `zip` makes a row of each line of a row's cells, where a cell of one line goes to all; `join` takes all rows of one cell as lists, one below the other, and pairs them."""
    found = (_HeldRows if "~=" in klass else _Rows)(table, klass, row, cell, attribute)
    found.feed(page or "")
    found.close()
    if not lines:
        return [[" ".join(c[0].split()) for c in r] for r in found.rows if r]
    rows = [[[" ".join(x.split()) for x in c[0].split("\n") if x.strip()] or [""] for c in r] for r in found.rows if r]
    if lines == "join":
        rows = [[[x[0] for x in r] for r in rows]]
    out = []
    for r in rows:
        most = max(map(len, r))
        out += [[c[k] if k < len(c) else c[0] if len(c) == 1 else "" for c in r] for k in range(most)]
    return out


#: Columns of a rule: where a shop's rows and cells are, which cells are name, buy and sell, and how prices read. Cells count from 1, below 0 from the end, which also finds prices where a name spans rows or a column is missing; also_at is a second cell of the name, lines is that of rows_of().
RULE = "store string, table string, class string, row string, cell string, attribute string, name_at int, buy_at int, sell_at int, digits string, scale string, valid string, also_at int, lines string"


def html_rows(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """store, page_id, row_no, cells of pages (store, page_id, html) by the rules (RULE, a row a shop)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(s, p, n, r) for s, p, h, *rule in b.itertuples(index=False) for n, r in enumerate(rows_of(h, *rule))]
            yield pd.DataFrame(made, columns=["store", "page_id", "row_no", "cells"])

    both = pages.join(rules, "store").select("store", "page_id", "html", *(F.coalesce(c, F.lit("")).alias(c) for c in ("table", "class", "row", "cell", "attribute", "lines")))
    return both.mapInPandas(run, f"store string, page_id {kind}, row_no int, cells array<string>")


def html_prices(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """store, page_id, row_no, name, buy, sell of html_rows(): digits, scale and validity by the shop's rule."""
    r = html_rows(pages, rules).join(rules, "store")
    at = lambda c: F.try_element_at("cells", F.col(c))
    price = lambda c: price_scale(price_digits(at(c)), F.col("scale"))
    r = r.select("store", "page_id", "row_no", "valid", clean_name(F.concat_ws(" ", at("name_at"), at("also_at"))).alias("name"), price("buy_at").alias("buy"), price("sell_at").alias("sell"))
    return r.where(valid_price_row(F.col("name"), F.col("buy"), F.col("sell"), F.col("valid"))).drop("valid")


def json_prices(landed: DataFrame, fields: tuple[str, str, str], rows: str = "$", names: DataFrame | None = None, branch: tuple[str, str] | None = None) -> DataFrame:
    """store, name, buy, sell from JSON lists (store, payload): rows are objects with the named fields, or arrays with the fields' positions such as [0].

    names (code, name) puts names to codes; branch (field, value) keeps one branch's rows.
    """
    path = lambda f: f"${f}" if f.startswith("[") else f"$.{f}"
    listed = F.col("payload") if rows == "$" else F.get_json_object("payload", rows)
    r = landed.select("store", F.explode(F.from_json(listed, "array<string>")).alias("r"))
    if branch:
        r = r.where(F.get_json_object("r", path(branch[0])) == branch[1])
    r = r.select("store", *(F.get_json_object("r", path(f)).alias(c) for f, c in zip(fields, ("name", "buy", "sell"))))
    if names is not None:
        r = r.join(names.select(F.col("code").alias("name"), F.col("name").alias("__full")), "name", "left").withColumn("name", F.coalesce("__full", "name"))
    return r.select("store", "name", *(F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("buy", "sell")))


def text_prices(records: DataFrame, names: DataFrame) -> DataFrame:
    """name, buy, sell, trend from text records (text): a line each for id, buy, sell and trend, blank ones aside; three at least, of ids in names (code, name)."""
    lines = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    r = records.select(lines.alias("x")).where(F.size("x") >= 3)
    r = r.select(F.element_at("x", 1).alias("code"), price_digits(F.element_at("x", 2)).alias("buy"), price_digits(F.element_at("x", 3)).alias("sell"), F.try_element_at("x", F.lit(4)).alias("trend"))
    return r.join(names, "code").select("name", "buy", "sell", "trend")


#: The columns of a bank's rates, in order.
BANK_COLUMNS = ("bank", "rate_1", "rate_3", "rate_6", "rate_9", "rate_12")


def bank_rates(landed: DataFrame) -> DataFrame:
    """BANK_COLUMNS as text, and the rates as numbers, of landed responses (payload).

    An entry has its values in C; those it lacks are "N/A" if R says that values were cut, else empty; null is empty.
    Entries without values are left out.
    """
    entry = "struct<C:array<string>,R:int>"
    schema = f"struct<results:array<struct<result:struct<data:struct<dsr:struct<DS:array<struct<PH:array<struct<DM1:array<{entry}>>>>>>>>>>>"
    r = landed.select(F.from_json("payload", schema).alias("p")).select(F.col("p.results")[0]["result"]["data"]["dsr"]["DS"].alias("ds"))
    r = r.select(F.explode("ds").alias("d")).select(F.explode("d.PH").alias("h")).select(F.explode("h.DM1").alias("e")).where(F.size("e.C") > 0)
    value = lambda i: F.when(F.lit(i) < F.size("e.C"), F.coalesce(F.col("e.C")[i], F.lit(""))).when(F.col("e.R") > 0, "N/A").otherwise("")
    r = r.select(*(value(i).alias(c) for i, c in enumerate(BANK_COLUMNS)))
    return r.withColumns({f"{c}_num": F.expr(f"CAST(try_cast({c} AS DECIMAL(6,3)) AS DOUBLE)") for c in BANK_COLUMNS[1:]})


def fx_rates(landed: DataFrame) -> DataFrame:
    """The columns of landed (but payload), code, sell, cash (texts) from {"Data": [...]}."""
    keep = [c for c in landed.columns if c != "payload"]
    rows = F.from_json("payload", "struct<Data:array<struct<currencyCode:string,sell:string,cash:string>>>")["Data"]
    return landed.select(*keep, F.inline(rows).alias("code", "sell", "cash"))


def index_members(landed: DataFrame, local: DataFrame) -> DataFrame:
    """index, symbol: the local members (index, symbol), and for indices without any those of landed lists (index, payload)."""
    far = landed.join(local.select("index").distinct(), "index", "left_anti").select("index", F.explode(F.from_json("payload", "array<string>")).alias("symbol"))
    return local.select("index", "symbol").unionByName(far)


def price_dedup(rows: DataFrame, keys: list[str], order: str = "row_no") -> DataFrame:
    """The first of scraped rows with equal keys, by `order`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def deltas(boards: DataFrame, futures: bool = False) -> DataFrame:
    """batch, symbol, changes (array of index, change in order of arrival) from boards (batch, payload): a JSON list of [cell, text, ...] rows.

    Stock rows have three items. Rows that can't be read are left out; see rejected_deltas().
    """
    r = _deltas(boards, futures).where("ok")
    item = F.struct("pos", "index", "change")
    g = r.groupBy("batch", "symbol").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select("batch", "symbol", F.transform("x", lambda x: F.struct(x["index"].alias("index"), x["change"].alias("change"))).alias("changes"))


def rejected_deltas(boards: DataFrame, futures: bool = False) -> DataFrame:
    return _deltas(boards, futures).where("not ok").select("batch", "pos", "cells")


def _deltas(boards: DataFrame, futures: bool) -> DataFrame:
    from ..functions.scalars import delta_key, delta_value

    r = boards.select("batch", F.posexplode(F.from_json("payload", "array<array<string>>")).alias("pos", "cells"))
    symbol, index = delta_key(F.col("cells")[0], F.lit(futures))
    change = delta_value(F.col("cells")[1])
    r = r.withColumns({"symbol": symbol, "index": index.try_cast("int"), "change": change})
    ok = F.col("index").isNotNull() & F.col("change").isNotNull() & (F.lit(True) if futures else F.size("cells") == 3)
    return r.withColumn("ok", F.coalesce(ok, F.lit(False)))
