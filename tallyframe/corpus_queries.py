"""Queries over the texts of the shared tables, documents, pages, conversations and benchmark, each with its SQL where SQL can state it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import claims
from .functions import text as txt
from .operators import aggregate as agg
from .operators import charts, citations, figure_checks, ledger, pairs, profile, quotes
from .plans.settled import shared_dir
from .queries import Tables, long, query, r4
from .sources import blocks, tabular


def joined(c, sep="|"):
    return F.array_join(c, sep)


def _each(spark, d) -> DataFrame:
    """(id, text) of every text of documents and benchmark; items have negative ids."""
    t = Tables(spark, d)
    return t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.benchmark.select((-1 - F.col("item_id")).alias("id"), "text"))


_EACH = "(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - item_id, coalesce(text, '') FROM benchmark)"


# -- delimited text ------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars FROM documents")
def csv_documents(spark, d):
    """documents written as CSV, line breaks and quotation marks inside cells, and read back by splits."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows = Tables(spark, d).documents.select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.options(header=True, escape='"', quoteAll=True, emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    return tabular.read_csv(spark, folder)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS \"name [2]\" FROM nation UNION ALL SELECT 'key', 'name', 'name'")
def csv_scan(spark, d):
    """nation as a CSV with a title, a blank line, repeated headers and a data row that reads like the header, written and read back."""
    lines = Tables(spark, d).nation.select(F.col("n_nationkey").cast("int").alias("i"), F.format_string('%s,"%s",%s', F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    top = spark.createDataFrame([(-4, "Nations of the report"), (-3, ""), (-2, "key,name,name"), (-1, "key,name,name")], "i int, value string")
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    lines.unionByName(top).coalesce(1).sortWithinPartitions("i").select("value").write.text(folder)  # one file of 29 lines
    return tabular.read_csv(spark, folder)


# -- quotations and figures of drafts --------------------------------------------------------------

_LETTERS = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_QUOTES = """q AS (SELECT item_id, 'whole' AS kind, [text] AS parts FROM benchmark UNION ALL SELECT item_id, 'elided', [substr(text, 1, 30), substr(text, greatest(31, length(text) - 29), 30)] FROM benchmark UNION ALL SELECT item_id, 'false', ['Zq ' || text] FROM benchmark),
s AS (SELECT item_id, kind, list_filter(list_transform(parts, lambda x: """ + _LETTERS.format("x") + """), lambda x: length(x) >= 3) AS segs FROM q)"""


def _planted(spark, d) -> DataFrame:
    """(item_id, kind, quote): each benchmark item quoted as a whole, with its middle left out, and with a word that is not in it."""
    b = Tables(spark, d).benchmark
    whole = b.select("item_id", F.lit("whole").alias("kind"), F.col("text").alias("quote"))
    middle = F.concat(F.substring("text", 1, 30), F.lit(" … "), F.substring(F.col("text"), F.greatest(F.lit(31), F.length("text") - 29), F.lit(30)))
    return whole.unionByName(b.select("item_id", F.lit("elided").alias("kind"), middle.alias("quote"))).unionByName(b.select("item_id", F.lit("false").alias("kind"), F.concat(F.lit("Zq "), "text").alias("quote")))


@query(f"""WITH {_QUOTES}, p AS (SELECT doc_id, {_LETTERS.format("coalesce(text, '')")} AS t, lead(doc_id) OVER (ORDER BY doc_id) AS next_id, lead({_LETTERS.format("coalesce(text, '')")}) OVER (ORDER BY doc_id) AS next_t FROM documents),
j AS (SELECT doc_id, next_id, length(t) AS n, t || coalesce(next_t, '') AS t FROM p),
m AS (SELECT item_id, kind, segs, doc_id, next_id, n, t, strpos(t, segs[1]) AS a FROM s, j WHERE len(segs) > 0 AND strpos(t, segs[1]) BETWEEN 1 AND n),
e AS (SELECT *, CASE WHEN len(segs) = 1 THEN a + length(segs[1]) - 1 WHEN strpos(substr(t, a + length(segs[1])), segs[2]) > 0 THEN a + length(segs[1]) - 1 + strpos(substr(t, a + length(segs[1])), segs[2]) + length(segs[2]) - 1 END AS z FROM m),
f AS (SELECT item_id, kind, min(doc_id) AS page_id, arg_min(CASE WHEN z > n THEN next_id ELSE doc_id END, doc_id) AS end_page FROM e WHERE z IS NOT NULL GROUP BY ALL)
SELECT s.item_id, s.kind, f.page_id IS NOT NULL AS found, f.page_id, f.end_page FROM s LEFT JOIN f ON f.item_id = s.item_id AND f.kind = s.kind""")
def quotes_in_documents(spark, d):
    asked = _planted(spark, d)
    pages = Tables(spark, d).documents.select(F.col("doc_id").alias("page_id"), "text")
    return asked.join(quotes.find_quotes(asked, quotes.with_source(pages)), "quote").select("item_id", "kind", "found", "page_id", "end_page")


@query()
def closest_passages(spark, d):
    """For each benchmark item the document with the longest stretch of its letters; tests compare it with brute force."""
    t = Tables(spark, d)
    asked = t.benchmark.select("item_id", F.col("text").alias("quote"))
    found = quotes.closest_passage(asked, t.documents.select(F.col("doc_id").alias("page_id"), "text"))
    return asked.join(found, "quote").select("item_id", "page_id", "size", "at")


@query()
def document_figures(spark, d):
    """Each figure of documents with its place, unit and context; tests compare it with a reader of single characters."""
    found = figure_checks.page_figures(Tables(spark, d).documents.select(F.col("doc_id").alias("page_id"), "text"))
    return found.select("page_id", "start", "end", "number", "unit", "value", F.length("context").alias("around"), F.sha2("context", 256).alias("context_sha256"))


@query()
def figure_support(spark, d):
    """The figures of all documents against all documents, those of the document itself among them; tests compare it with brute force."""
    docs = Tables(spark, d).documents
    draft = docs.select(F.col("doc_id").alias("draft_id"), "text")
    return figure_checks.check_figures(draft, docs.select(F.col("doc_id").alias("page_id"), "text")).drop("source")


@query()
def nearest_figures_found(spark, d):
    """For the figures of all documents the closest other figure in a context that shares its sentence's words; tests compare it with brute force."""
    docs = Tables(spark, d).documents
    draft = docs.select(F.col("doc_id").alias("draft_id"), "text")
    return figure_checks.nearest_figure(draft, docs.select(F.col("doc_id").alias("page_id"), "text")).drop("source")


# -- pairs, grids ----------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(coalesce(sum(a.n * b.n) FILTER (a.y < b.y), 0) AS BIGINT) AS concordant, CAST(coalesce(sum(a.n * b.n) FILTER (a.y > b.y), 0) AS BIGINT) AS discordant, CAST(coalesce(sum(a.n * b.n) FILTER (a.y = b.y), 0) AS BIGINT) AS tied FROM g a JOIN g b ON a.x < b.x""")
def pairs_quantity_discount(spark, d):
    return pairs.pair_counts(Tables(spark, d).lineitem, "l_quantity", "l_discount")


@query("""WITH c AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT DISTINCT x FROM c),
u AS (SELECT x.x AS below, y.y, sum(CASE WHEN y.x = x.x THEN 1 ELSE 0 END) AS held, sum(CASE WHEN y.x > x.x THEN 1 ELSE 0 END) AS asked FROM k x, c y GROUP BY ALL),
r AS (SELECT below, asked, held, sum(held) OVER (PARTITION BY below ORDER BY y) AS upto, sum(held) OVER (PARTITION BY below) AS every FROM u)
SELECT CAST(sum(asked * (upto - held)) AS BIGINT) AS concordant, CAST(sum(asked * (every - upto)) AS BIGINT) AS discordant, CAST(sum(asked * held) AS BIGINT) AS tied FROM r""")
def pairs_quantity_price(spark, d):
    return pairs.pair_counts(Tables(spark, d).lineitem, "l_quantity", "l_extendedprice")


@query("""WITH g AS (SELECT l_tax AS x, l_discount AS y, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT a.n * b.n AS n, sign(b.x - a.x) * sign(b.y - a.y) AS s FROM g a, g b)
SELECT CAST(sum(n) FILTER (s > 0) // 2 AS BIGINT) AS together, CAST(sum(n) FILTER (s < 0) // 2 AS BIGINT) AS apart, CAST((sum(n) FILTER (s = 0) - (SELECT count(*) FROM lineitem)) // 2 AS BIGINT) AS still FROM p""")
def moves_tax_discount(spark, d):
    return pairs.moves(Tables(spark, d).lineitem, "l_tax", "l_discount")


_GRID = "SELECT r_name, n_name, c_nationkey, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"
_GRID_COLUMNS = ("r_name", "n_name", "c_nationkey", "c_mktsegment", "customers", "total")


@query(f"WITH g AS ({_GRID}), n AS (SELECT count(*) AS n FROM g) " + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS columns, count(DISTINCT {a}) AS levels_a, count(DISTINCT {b}) AS levels_b, max(n) AS rows FROM g, n HAVING count(DISTINCT {a}) * count(DISTINCT {b}) = max(n) AND count(DISTINCT ({a}, {b})) = max(n) AND least(count(DISTINCT {a}), count(DISTINCT {b})) > 1 AND greatest(count(DISTINCT {a}), count(DISTINCT {b})) < max(n)"
    for i, a in enumerate(_GRID_COLUMNS) for b in _GRID_COLUMNS[i + 1 :]))
def grids_found(spark, d):
    """The pairs of columns that lay out customers' totals by nation and segment, found among all pairs."""
    t = Tables(spark, d)
    star = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = star.groupBy(*_GRID_COLUMNS[:4]).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    found = profile.crossed_sets(rows, list(_GRID_COLUMNS))
    return found.select(joined("columns").alias("columns"), F.get("levels", F.lit(0)).alias("levels_a"), F.get("levels", F.lit(1)).alias("levels_b"), "rows")


_LAYOUT = ("l_linenumber", "l_returnflag", "l_linestatus", "l_discount")


@query(f"WITH g AS (SELECT {', '.join(_LAYOUT)}, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT count(*) AS n, " + ", ".join(f"count(DISTINCT {c}) AS d{i}" for i, c in enumerate(_LAYOUT)) + " FROM g) SELECT '" + "|".join(_LAYOUT) + "' AS columns, n AS rows FROM k WHERE d0 * d1 * d2 * d3 = n")
def layout_found(spark, d):
    """The four factors that lay out lineitem's counts, found among all sets of two, three and four columns."""
    rows = Tables(spark, d).lineitem.groupBy(*_LAYOUT).agg(F.count("*").alias("n"))
    return profile.crossed_sets(rows, [*_LAYOUT, "n"], (2, 3, 4)).select(joined("columns").alias("columns"), "rows")


@query("SELECT 'n_name' AS axis, 'c_mktsegment' AS legend, 'bar' AS chart WHERE (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) = count(DISTINCT c_nationkey) * count(DISTINCT c_mktsegment) FROM customer)")
def crossed_chart(spark, d):
    """How customers' mean balances by nation and segment are drawn: two labels that name a row together."""
    t = Tables(spark, d)
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.avg("c_acctbal").alias("balance"))
    crossed = charts.crossed_labels(rows, ["n_name", "c_mktsegment"])
    found = [(crossed[0][0], crossed[1], "bar")] if crossed else []
    return spark.createDataFrame(found, "axis string, legend string, chart string")


# -- sentences, links, chunks, search -----------------------------------------------------------------

_MARK, _HELD = "chr(1)", "chr(2)"
_ABBREVIATED = "(^|[^\\p{L}\\p{N}_])((?:et al|e\\.g|i\\.e|cf|vs|Figs?|Eqs?|No|approx|resp|Sec|Tab|ca|al|pp?|[Vv]ol|ch|Dr|Mr|Ms|Prof|[A-Z])\\.)([\"”’)\\]]*\\s)"
_SENTENCES = f"""f AS (SELECT id, list_transform(string_split(text, '"'), lambda x, i: CASE WHEN i % 2 = 0 THEN regexp_replace(x, '([.!?])([^”’)\\]])', '\\1' || {_HELD} || '\\2', 'g') ELSE x END) AS parts FROM (SELECT id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '\\n[ \\t]*(\\n[ \\t]*)+', {_MARK}, 'g'), {_MARK})), '\\s*\\n\\s*', ' ', 'g'), chr(32) || chr(9) || chr(10)) AS text FROM {_EACH})),
a AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(array_to_string(parts, '"'), '{_ABBREVIATED}', '\\1\\2' || {_HELD} || '\\3', 'g'), '{_ABBREVIATED}', '\\1\\2' || {_HELD} || '\\3', 'g'), '([.!?]["”’)\\]]*)\\s+', '\\1' || {_MARK}, 'g') AS t FROM f),
x AS (SELECT id, trim(replace(unnest(string_split(t, {_MARK})), {_HELD}, '')) AS s FROM a)"""


@query(f"WITH {_SENTENCES} SELECT id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars, max(length(s)) AS longest FROM x WHERE regexp_matches(s, '[A-Za-z0-9]') GROUP BY id")
def sentence_split(spark, d):
    each = _each(spark, d).select("id", F.explode(txt.sentences(F.col("text"))).alias("s"))
    return each.groupBy("id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).cast("long").alias("chars"), F.max(F.length("s")).cast("long").alias("longest"))


_SITE = "regexp_extract(url, '(?i)^https?://[^/?#]+')"
_LINKS = f"""l AS (SELECT page_id, {_SITE} AS site, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2)) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), 1) AS i FROM pages),
u AS (SELECT page_id * 100000 + i AS place, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS url, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM l),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim(url), '/+$', ''), '[ \\t，,、。.；;：:）)】」』]+$', '')), '^https?://', ''), '^www\\.', '') AS key FROM u WHERE regexp_matches(url, '(?i)^https?://') AND NOT regexp_matches(url, '(?i)\\.(?:jpe?g|png|gif|webp|svg|bmp|ico|tiff?|avif|heic)(?:[?#].*)?$')
 AND NOT regexp_matches(regexp_extract(regexp_replace(url, '(?i)^https?://', ''), '^[^/]*'), '(?i)^(?:m\\.media-|images?[.-]|img[.-]|static[.-]|assets?[.-]|cdn[.-]|media[.-])|(?:\\.cdn\\.|\\.imgix\\.|cloudfront\\.net$|akamaized\\.net$)'))"""


@query(f"WITH {_LINKS} SELECT key, count(*) AS occurrences, coalesce(arg_min(title, place) FILTER (title <> ''), '') AS title, arg_min(url, place) AS url, CASE WHEN count(*) FILTER (title <> '') > 0 THEN 'link' ELSE 'url' END AS kind FROM k GROUP BY key")
def linked_sources(spark, d):
    """What the anchors of pages point at, each address once, with its first title."""
    found = citations.merged(citations.page_links(Tables(spark, d).pages))
    return found.select("key", "occurrences", "title", "url", "kind")


@query("""WITH t AS (SELECT conv_id AS doc, turn, CASE WHEN turn % 2 = 0 THEN '[' || substr(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), 1, 20) || '](https://Site' || conv_id % 40 || '.org/p/)' ELSE 'see http://www.site' || conv_id % 40 || '.org/p. (Source: Press ' || conv_id % 7 || ', 20' || (10 + conv_id % 9) || ')' END AS text FROM conversations WHERE coalesce(text, '') <> ''),
m AS (SELECT doc * 1000 + turn AS place, 'site' || doc % 40 || '.org/p' AS key, CASE WHEN turn % 2 = 0 THEN trim(regexp_extract(text, '^\\[([^\\]]*)', 1)) ELSE '' END AS title, CASE WHEN turn % 2 = 0 THEN 'link' ELSE 'url' END AS kind FROM t
UNION ALL SELECT doc * 1000 + turn, 'press ' || doc % 7 || '|20' || (10 + doc % 9), '', 'attribution' FROM t WHERE turn % 2 <> 0)
SELECT key, count(*) AS occurrences, coalesce(arg_min(title, place) FILTER (title <> ''), '') AS title, CASE WHEN count(*) FILTER (title <> '') > 0 THEN 'link' ELSE arg_min(kind, place) END AS kind FROM m GROUP BY key""")
def cited_in_conversations(spark, d):
    """Sources merged over all turns of conversations, each of which cites one: a titled link, or a bare address and an attribution."""
    c = Tables(spark, d).conversations.where(F.coalesce("text", F.lit("")) != "")
    title = F.substring(F.regexp_replace("text", "[^A-Za-z]+", " "), 1, 20)
    link = F.concat(F.lit("["), title, F.lit("](https://Site"), (F.col("conv_id") % 40).cast("string"), F.lit(".org/p/)"))
    bare = F.concat(F.lit("see http://www.site"), (F.col("conv_id") % 40).cast("string"), F.lit(".org/p. (Source: Press "), (F.col("conv_id") % 7).cast("string"), F.lit(", 20"), (10 + F.col("conv_id") % 9).cast("string"), F.lit(")"))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.when(F.col("turn") % 2 == 0, link).otherwise(bare).alias("text"))
    return citations.cited_sources(rows).select("key", "occurrences", "title", "kind")


@query()
def long_block_chunks(spark, d):
    """documents as blocks, long ones in chunks; tests compare the packing with a plain loop."""
    out = blocks.split_long(Tables(spark, d).documents, "doc_id", "text")
    return out.select("doc_id", long("chunk", "chunk"), long("first_line", "first_line"), long("last_line", "last_line"), F.length("content").cast("long").alias("chars"), F.sha2("content", 256).alias("sha256"))


@query("""WITH q AS (SELECT item_id, trim(lower(substr(text, 1, 60))) AS phrase FROM benchmark), t AS (SELECT item_id, phrase, list_distinct(regexp_extract_all(phrase, '[a-z0-9]+')) AS terms FROM q),
s AS (SELECT item_id, doc_id, CAST(list_sum(list_transform(terms, lambda x: contains(low, x)::INT)) + 3 * contains(low, phrase)::INT AS DOUBLE) AS score FROM t, (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def ledger_search_many(spark, d):
    """The ten best documents for the beginning of each benchmark item, all at once."""
    t = Tables(spark, d)
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), F.substring("text", 1, 60).alias("text"))
    found = ledger.search_many(t.documents, asked, ["text"], 10, "doc_id")
    return found.select(F.col("question_id").alias("item_id"), "doc_id", "score", long("rank", "rank"))


# -- checks of prose over whole texts -----------------------------------------------------------------


@query(f"""SELECT id, CAST(len(regexp_extract_all(text, '"[^"]{{4,200}}"')) AS BIGINT) AS marked FROM {_EACH} WHERE contains(text, '"')""")
def quoted_passages(spark, d):
    rows = _each(spark, d).where(F.col("text").contains('"'))
    return rows.select("id", F.size(F.regexp_extract_all("text", F.lit(txt.QUOTED), 0)).cast("long").alias("marked"))


_LINES = "(SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
#: Where a word begins or ends, for letters of any script.
_EDGE = "(?:^|$|[^\\p{L}\\p{N}_])"


@query("SELECT doc_id, family, count(*) AS lines FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS family FROM {_LINES} WHERE regexp_matches(line, '{p.replace(chr(92) + 'b', _EDGE)}')" for n, p in txt.REGISTER) + ") GROUP BY ALL")
def register_scan(spark, d):
    rows = Tables(spark, d).documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return rows.select("doc_id", F.explode(txt.register_violations(F.col("line"))).alias("family")).groupBy("doc_id", "family").agg(F.count("*").alias("lines"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '\\b(?:[a-z]+(?:_[a-z0-9]+)+|E_[A-Za-z0-9]+_[0-9a-f]{6,})\\b'))) AS tokens FROM documents")
def machine_tell(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.size(txt.internal_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("""WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
c AS (SELECT doc_id, n, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 'fence' WHEN regexp_matches(line, '^#{1,6}\\s') THEN 'heading' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' WHEN regexp_matches(line, '^\\s*([-*+]|[0-9]+[.)])\\s') THEN 'list' ELSE 'paragraph' END AS kind FROM l),
f AS (SELECT *, sum((kind = 'fence')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM c), k AS (SELECT doc_id, n, line, CASE WHEN fences % 2 = 1 OR kind = 'fence' THEN 'code' ELSE kind END AS kind FROM f),
b AS (SELECT *, sum((p IS NULL OR p <> kind OR kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM k))
SELECT doc_id, kind AS block_type, CAST(min(n) AS BIGINT) AS line_start, CAST(max(n) AS BIGINT) AS line_end, sum(length(line)) + count(*) - 1 AS chars FROM b WHERE kind <> 'blank' GROUP BY doc_id, block, kind""")
def text_blocks(spark, d):
    found = blocks.blocks_of(Tables(spark, d).documents)
    return found.select("doc_id", "block_type", long("line_start", "line_start"), long("line_end", "line_end"), F.length("content").cast("long").alias("chars"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
s AS (SELECT *, regexp_matches(line, '^#{1,6}\\s') AND trim(line) <> '' AS head, sum((regexp_matches(line, '^#{1,6}\\s') AND trim(line) <> '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) FILTER (NOT head AND trim(line) <> '') AS n_lines, CAST(coalesce(sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))) FILTER (NOT head AND trim(line) <> ''), 0) AS BIGINT) AS n_words FROM s GROUP BY doc_id, section""")
def document_sections(spark, d):
    return blocks.sections_of(Tables(spark, d).documents).select("doc_id", long("section", "section"), "n_lines", "n_words")


@query("""SELECT doc_id, trim(coalesce(text, '')) LIKE '%?' AND NOT regexp_matches(regexp_replace(trim(coalesce(text, '')), '\\?$', ''), '[。．.!！;；]') AS asks FROM documents""")
def question_only(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", claims.is_question_only(F.col("text")).alias("asks"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), f AS (SELECT * FROM r WHERE i <= 25),
p AS (SELECT a.doc_id, b.doc_id AS other, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.i) AS n FROM r a JOIN f b ON a.source = b.source AND a.doc_id <> b.doc_id)
SELECT r.doc_id, coalesce(s.siblings, '') AS siblings FROM r LEFT JOIN (SELECT doc_id, string_agg(CAST(other AS VARCHAR), '|' ORDER BY n) AS siblings FROM p WHERE n <= 24 GROUP BY 1) s USING (doc_id)""")
def cross_references(spark, d):
    out = ledger.cross_references(Tables(spark, d).documents, "source", "doc_id", "doc_id")
    return out.select("doc_id", joined(F.transform("siblings", lambda x: x.cast("string"))).alias("siblings"))


@query("SELECT doc_id, source FROM documents")
def ledger_listing(spark, d):
    docs = Tables(spark, d).documents
    return ledger.listed(ledger.cross_references(docs, "source", "doc_id", "doc_id").join(docs.select("doc_id", "source"), "doc_id")).select("doc_id", "source")


# -- whole tables summed up -----------------------------------------------------------------------------


@query("""SELECT 'c_acctbal' AS "column", 'numeric' AS summary, count(*) AS n, min(c_acctbal) AS least, round(median(c_acctbal), 4) AS middle, max(c_acctbal) AS most, CAST(NULL AS BIGINT) AS groups, CAST(NULL AS VARCHAR) AS top FROM customer
UNION ALL SELECT 'c_mktsegment', 'categorical', (SELECT count(c_mktsegment) FROM customer), NULL, NULL, NULL, (SELECT count(DISTINCT c_mktsegment) FROM customer), (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'c_name', 'counted', (SELECT count(c_name) FROM customer), NULL, NULL, NULL, NULL, NULL""")
def dataset_summary(spark, d):
    out = agg.dataset_summary(Tables(spark, d).customer.select("c_name", "c_mktsegment", "c_acctbal"))
    return out.select("column", "summary", "n", "least", r4("middle", "middle"), "most", "groups", "top")


@query("SELECT true AS amount, false AS rate, false AS negative, count(*) AS n, min(c_acctbal) AS least, max(c_acctbal) AS most, round(avg(c_acctbal), 4) AS mean FROM customer")
def additive_and_error(spark, d):
    c = Tables(spark, d).customer
    positive = c.select(F.abs("c_acctbal").alias("amount"), F.abs("c_acctbal").alias("rate"), (F.abs("c_acctbal") * -1 - 1).alias("cost"))
    tests = [agg.is_additive(positive, x).select(F.col("additive").alias(n)) for x, n in (("amount", "amount"), ("rate", "rate"), ("cost", "negative"))]
    return tests[0].join(tests[1]).join(tests[2]).join(agg.error_range(c, "c_acctbal").select("n", "least", "most", r4("mean", "mean")))  # one row each
