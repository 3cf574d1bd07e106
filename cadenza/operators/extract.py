"""HTML to typed blocks, for many pages at once.

A page is cut into segments (a tag and the text behind it). One fold per page
keeps the stack of open elements; every entry carries what its subtree needs to
know (whether it is silent, which block it belongs to, which list items own its
text), so a step looks at the top of the stack only. The fold gives the page's
visible text runs and the places where a line breaks; everything after that is
grouping. The fold runs over slices of SLICE segments, so a page of any length
is folded in time near to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadenza.functions import text as T

#: Element names by their part in narration.
BLOCKS = ("h1", "h2", "h3", "h4", "p", "blockquote", "ul", "ol")
SILENT = ("style", "script", "figure", "img", "iframe", "form", "button", "input", "select", "textarea", "nav", "footer", "aside")
BREAKING = ("address", "article", "aside", "blockquote", "div", "figcaption", "footer", "h1", "h2", "h3", "h4", "header", "li", "main", "ol", "p", "section", "ul")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer")
CARD = "kg-card"
LISTS = ("ul", "ol")
SLICE = 256
#: Stands for a line break among text runs; a noncharacter, so no interchanged text holds it.
BREAK = "\ufdd0"
#: A segment: comment, declaration, script, style, tag (a quoted ">" does not end it), or leading text; then text up to the next tag.
SEGMENT = (
    r"(?is)(<!--.*?(?:-->|\z)|<[!?][^>]*>?|<(?:script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?:script|style)\s*>|\z)"
    r"|</?[a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<|^(?=[^<]))([^<]*)"
)


def split_empty_documents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with anything but white space, and the others with a reason."""
    blank = T.is_blank(F.col("html"))
    return pages.filter(~blank), pages.filter(blank).withColumn("reason", F.lit("the page is empty"))


def _segment_array(html: Column) -> Column:
    """Segments of a page, parsed: seg, kind (open, close, skip, text), name, card, alone (closes itself), txt."""
    html = F.regexp_replace(html, BREAK, " ")
    tags, texts = F.regexp_extract_all(html, F.lit(SEGMENT), F.lit(1)), F.regexp_extract_all(html, F.lit(SEGMENT), F.lit(2))

    def named(z: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(z["tag"], r"^</?([a-zA-Z][^\s/>]*)", 1))
        return F.struct(i.alias("seg"), z["tag"].alias("tag"), z["txt"].alias("txt"), name.alias("name"))

    def parsed(z: Column) -> Column:
        tag, name = z["tag"], z["name"]
        closes = tag.startswith("</")
        kind = F.when(name == "", F.when((tag == "") | (tag == "<"), "text").otherwise("skip")).when(closes, "close").when(name.isin("script", "style"), "skip").otherwise("open")
        css = F.regexp_extract(tag, r"""(?is)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
        card = F.when(tag.contains(CARD) & ~closes, F.array_contains(F.split(F.btrim(css, F.lit("\"'")), r"\s+"), CARD)).otherwise(False)
        txt = F.when(tag == "<", F.concat(F.lit("<"), z["txt"])).otherwise(z["txt"])
        return F.struct(z["seg"].alias("seg"), kind.alias("kind"), name.alias("name"), card.alias("card"), (name.isin(*VOID) | tag.endswith("/>")).alias("alone"), T.decode_entities(txt).alias("txt"))

    return F.transform(F.transform(F.arrays_zip(tags.alias("tag"), texts.alias("txt")), named), parsed)


def html_segments(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc_id, seg, kind, name, card, alone, txt."""
    return pages.select(F.col(id_col).alias("doc_id"), F.explode(_segment_array(F.col("html"))).alias("s")).select("doc_id", "s.*")


_ENTRY = "struct<name:string,seg:int,silent:boolean,breaks:boolean,root:int,root_name:string,owners:array<int>,outer:array<int>>"
_ITEM = "struct<seg:int,txt:string,root:int,root_name:string,owners:array<int>>"


def _fold(segments: Column, silent_tags: tuple[str, ...]) -> Column:
    """Items (text runs and breaks) of a page's segments, an array of struct _ITEM."""
    none = F.array().cast("array<int>")
    floor = F.struct(
        F.lit("").alias("name"), F.lit(-1).alias("seg"), F.lit(False).alias("silent"), F.lit(False).alias("breaks"), F.lit(None).cast("int").alias("root"),
        F.lit(None).cast("string").alias("root_name"), none.alias("owners"), none.alias("outer"),
    ).cast(_ENTRY)
    nothing = F.array().cast(f"array<{_ITEM}>")
    item = lambda seg, txt, root, name, owners: F.struct(seg.alias("seg"), txt.alias("txt"), root.alias("root"), name.alias("root_name"), owners.alias("owners")).cast(_ITEM)
    top = lambda stack: F.element_at(stack, -1)

    moved = lambda stack, broken: F.struct(stack.alias("stack"), broken.alias("broken"))

    def entered(parent: Column, s: Column) -> Column:
        name = s["name"]
        silent = parent["silent"] | name.isin(*silent_tags) | s["card"]
        owners = F.when(name.isin(*LISTS), none).when(name == "li", F.concat(parent["owners"], F.array(s["seg"]))).otherwise(parent["owners"])
        starts = parent["root"].isNull() & name.isin(*BLOCKS)
        return F.struct(
            name.alias("name"), s["seg"].alias("seg"), silent.alias("silent"), name.isin(*BREAKING).alias("breaks"),
            F.when(starts, s["seg"]).otherwise(parent["root"]).alias("root"), F.when(starts, name).otherwise(parent["root_name"]).alias("root_name"),
            owners.alias("owners"), F.when(name.isin(*LISTS), none).otherwise(parent["owners"]).alias("outer"),
        ).cast(_ENTRY)

    def step(state: Column, s: Column) -> Column:
        stack, out, name = state["stack"], state["out"], s["name"]
        opening, closing = s["kind"] == "open", s["kind"] == "close"

        def opened() -> Column:
            def go(x: Column) -> Column:
                parent, inner = x["parent"], x["inner"]
                breaks = F.when(name == "br", ~parent["silent"]).otherwise(name.isin(*BREAKING) & ~inner["silent"]) & parent["root"].isNotNull()
                owners = F.when(name == "br", parent["owners"]).otherwise(inner["outer"])
                grown = F.when(s["alone"], stack).otherwise(F.concat(stack, F.array(inner)))
                return moved(grown, F.when(breaks, F.array(item(s["seg"], F.lit(BREAK), parent["root"], parent["root_name"], owners))).otherwise(nothing))

            return T.let(T.let(top(stack), lambda parent: F.struct(parent.alias("parent"), entered(parent, s).alias("inner"))), go)

        def closed() -> Column:
            # the place of the nearest open element of that name, from the top; 0 if there is none
            place = F.array_position(F.reverse(F.transform(stack, lambda e: e["name"])), name).cast("int")

            def go(depth: Column) -> Column:
                edge = lambda e: e["breaks"] & ~e["silent"] & e["root"].isNotNull() & (e["root"] != e["seg"])
                popped = F.filter(F.slice(stack, F.size(stack) - depth + 1, depth), edge)
                broken = lambda p: F.when(
                    F.size(p) > 0, F.array(item(s["seg"], F.lit(BREAK), top(p)["root"], top(p)["root_name"], F.array_distinct(F.flatten(F.transform(p, lambda e: e["outer"])))))
                ).otherwise(nothing)
                return F.when(depth > 0, moved(F.slice(stack, 1, F.size(stack) - depth), T.let(popped, broken))).otherwise(moved(stack, nothing))

            return T.let(place, go)

        def speak(x: Column) -> Column:
            now = top(x["stack"])
            said = (s["txt"] != "") & ~now["silent"] & now["root"].isNotNull()
            own = F.array(item(s["seg"], s["txt"], now["root"], now["root_name"], now["owners"]))
            more = F.when(said, F.concat(x["broken"], own)).otherwise(x["broken"])
            return F.struct(x["stack"].alias("stack"), T.let(more, lambda m: F.when(F.size(m) > 0, F.concat(out, m)).otherwise(out)).alias("out"))

        return T.let(F.when(opening, opened()).when(closing, closed()).otherwise(moved(stack, nothing)), speak)

    state = lambda stack, out: F.struct(stack.alias("stack"), out.alias("out"))

    def slice_step(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, state(acc["stack"], nothing), step)
        return T.let(inner, lambda x: state(x["stack"], F.concat(acc["out"], F.array(x["out"]))))

    start = state(F.array(floor), F.array().cast(f"array<array<{_ITEM}>>"))
    return F.when(F.size(segments) > 0, F.aggregate(_slices(segments), start, slice_step, lambda acc: F.flatten(acc["out"]))).otherwise(nothing)


def open_paths(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc_id, seg, txt, path: every text run with the elements open around it, outermost first, as structs of name, seg, card.

    A closing tag closes the nearest open element of its name and what is open in it, or
    nothing; void elements and elements that close themselves are never open.
    """
    entry = "struct<name:string,seg:int,card:boolean>"
    run = f"struct<seg:int,txt:string,path:array<{entry}>>"
    nothing = F.array().cast(f"array<{run}>")
    state = lambda stack, out: F.struct(stack.alias("stack"), out.alias("out"))

    def moved(stack: Column, s: Column) -> Column:
        own = F.struct(s["name"].alias("name"), s["seg"].alias("seg"), s["card"].alias("card")).cast(entry)
        place = F.array_position(F.reverse(F.transform(stack, lambda e: e["name"])), s["name"]).cast("int")
        left = T.let(place, lambda depth: F.when(depth > 0, F.slice(stack, 1, F.size(stack) - depth)).otherwise(stack))
        return F.when((s["kind"] == "open") & ~s["alone"], F.concat(stack, F.array(own))).when(s["kind"] == "close", left).otherwise(stack)

    def step(x: Column, s: Column) -> Column:
        said = lambda stack: F.array(F.struct(s["seg"].alias("seg"), s["txt"].alias("txt"), stack.alias("path")).cast(run))
        return T.let(moved(x["stack"], s), lambda stack: state(stack, F.when(s["txt"] != "", F.concat(x["out"], said(stack))).otherwise(x["out"])))

    def slice_step(x: Column, part: Column) -> Column:
        return T.let(F.aggregate(part, state(x["stack"], nothing), step), lambda y: state(y["stack"], F.concat(x["out"], F.array(y["out"]))))

    start = state(F.array().cast(f"array<{entry}>"), F.array().cast(f"array<array<{run}>>"))
    fold = lambda segments: F.aggregate(_slices(segments), start, slice_step, lambda x: F.flatten(x["out"]))
    rows = pages.select(F.col(id_col).alias("doc_id"), _segment_array(F.col("html")).alias("_segments")).filter(F.size("_segments") > 0)
    return rows.select("doc_id", F.explode(fold(F.col("_segments"))).alias("i")).select("doc_id", "i.*")


def _slices(segments: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(segments) - 1) / SLICE).cast("int")), lambda k: F.slice(segments, k * SLICE + 1, SLICE))


def visible_items(pages: DataFrame, id_col: str = "page_id", silent: tuple[str, ...] = SILENT) -> DataFrame:
    """doc_id, seg, txt (BREAK for a line break), root (segment of the outermost block), root_name, owners (list items)."""
    segments = pages.select(F.col(id_col).alias("doc_id"), _segment_array(F.col("html")).alias("_segments"))
    return segments.select("doc_id", F.explode(_fold(F.col("_segments"), silent)).alias("i")).select("doc_id", "i.*")


def joined_text(items: Column) -> Column:
    """Text of an ordered array of runs: a break is one newline, unless nothing or an end of line is before it."""
    text = F.array_join(items, "")
    text = F.regexp_replace(F.regexp_replace(text, f"^{BREAK}+", ""), f"([\n\r]){BREAK}+", "$1")
    return F.regexp_replace(text, f"{BREAK}+", "\n")


def _ordered(*key: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("seg", "n", "txt"))), lambda x: x["txt"])


def block_texts(items: DataFrame) -> DataFrame:
    """doc_id, root, root_name, raw: the text of every block but lists, with its line breaks."""
    numbered = items.withColumn("n", (F.col("txt") != BREAK).cast("int"))  # at one segment the break comes first
    return numbered.filter(~F.col("root_name").isin(*LISTS)).groupBy("doc_id", "root", "root_name").agg(joined_text(_ordered()).alias("raw"))


def list_blocks(items: DataFrame) -> DataFrame:
    """doc_id, root, text: a block for every outer list, its items' own texts in order, joined by ". "."""
    numbered = items.filter(F.col("root_name").isin(*LISTS)).withColumn("n", (F.col("txt") != BREAK).cast("int"))
    owned = numbered.withColumn("li", F.explode("owners")).groupBy("doc_id", "root", "li").agg(T.normalize_ws(joined_text(_ordered())).alias("text")).filter("text <> ''")
    return owned.groupBy("doc_id", "root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("li", "text"))), lambda x: x["text"]), ". ").alias("text"))


def heading_blocks(texts: DataFrame) -> DataFrame:
    """doc_id, root, level, text."""
    rows = texts.filter(F.col("root_name").isin("h1", "h2", "h3", "h4"))
    return rows.select("doc_id", "root", F.substring("root_name", 2, 1).cast("int").alias("level"), T.normalize_ws(F.col("raw")).alias("text")).filter("text <> ''")


def paragraph_blocks(texts: DataFrame) -> DataFrame:
    """doc_id, root, text."""
    return texts.filter("root_name = 'p'").select("doc_id", "root", T.normalize_ws(F.col("raw")).alias("text")).filter("text <> ''")


def quote_blocks(texts: DataFrame) -> DataFrame:
    """doc_id, root, speaker, text: attribution taken off, white space collapsed, quotation marks stripped."""
    rows = texts.filter("root_name = 'blockquote'").withColumn("a", T.split_attribution(F.col("raw")))
    return rows.select("doc_id", "root", F.col("a.speaker").alias("speaker"), T.strip_quotes(T.normalize_ws(F.col("a.text"))).alias("text")).filter("text <> ''")


def extract_blocks(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc_id, pos (from 0), type, level, speaker, text, in document order.

    Both kinds of block come from one grouping by (doc_id, root), so the visible
    text is shuffled once and stays where the numbering needs it.
    """
    items = visible_items(pages, id_col).withColumn("n", (F.col("txt") != BREAK).cast("int"))
    listed = F.col("root_name").isin(*LISTS)
    rows = items.withColumn("li", F.explode(F.when(listed, F.col("owners")).otherwise(F.array(F.lit(-1)))))
    one = rows.groupBy("doc_id", "root", "root_name", "li").agg(joined_text(_ordered()).alias("raw"))
    one = one.withColumn("part", F.when(F.col("li") >= 0, T.normalize_ws(F.col("raw"))).otherwise(F.col("raw"))).filter((F.col("li") < 0) | (F.col("part") != ""))
    whole = one.groupBy("doc_id", "root", "root_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("li", "part"))), lambda x: x["part"]), ". ").alias("raw"))
    quote = F.col("root_name") == "blockquote"
    said = whole.withColumn("a", F.when(quote, T.split_attribution(F.col("raw"))))
    blocks = said.select(
        "doc_id",
        "root",
        F.when(quote, "quote").when(F.col("root_name").isin(*LISTS), "list").when(F.col("root_name") == "p", "paragraph").otherwise("heading").alias("type"),
        F.when(F.col("root_name").rlike("^h[1-4]$"), F.substring("root_name", 2, 1).cast("int")).alias("level"),
        F.col("a.speaker").alias("speaker"),
        F.when(quote, T.strip_quotes(T.normalize_ws(F.col("a.text")))).otherwise(T.normalize_ws(F.col("raw"))).alias("text"),
    ).filter("text <> ''")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("root")) - 1
    return blocks.select("doc_id", pos.alias("pos"), "type", "level", "speaker", "text")


def documents_without_blocks(pages: DataFrame, blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """doc_id, reason of pages that give no block."""
    ids = pages.select(F.col(id_col).alias("doc_id"))
    return ids.join(blocks.select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_anti").withColumn("reason", F.lit("the page has no block to narrate"))


def rejected_pages(pages: DataFrame, blocks: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """doc_id, reason of pages that are empty or give no block."""
    some, empty = split_empty_documents(pages)
    without = documents_without_blocks(some, extract_blocks(some, id_col) if blocks is None else blocks, id_col)
    return empty.select(F.col(id_col).alias("doc_id"), "reason").unionByName(without.select("doc_id", "reason"))
