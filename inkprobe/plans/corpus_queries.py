"""Registered queries: sources, sinks, filters, pages and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprobe import params
from inkprobe.operators import books, catalogue
from inkprobe.operators import sampling as sp
from inkprobe.operators import tokens as tk
from inkprobe.plans.registry import (
    block,
    documents,
    is_member,
    is_non_member,
    query,
)
from inkprobe.session import run_folder
from inkprobe.sources import corpora, sinks

# -------------------------------------------------------- sources and sinks


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON lines; Spanish ones come cut off and are malformed."""
    line = F.to_json(F.struct(F.struct("lang", "source").alias("meta"), "text"))
    cut = F.when(F.col("lang") == "es", F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return documents(spark, d).select("doc_id", cut.alias("value"))


@query("a1_jsonl_corpus", """
  SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS meta,
         md5(text) AS text_md5
  FROM documents WHERE lang <> 'es'""")
def a1(spark, d):
    rows = corpora.parse_jsonl(json_lines(spark, d))
    return rows.select("doc_id", "meta", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("a2_union_splits", """
  SELECT 'documents' AS split, doc_id AS row_id, length(text) AS n_chars FROM documents
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, length(text) FROM conversations""")
def a2(spark, d):
    docs = corpora.table(spark, d, "documents").select(
        F.lit("documents").alias("split"), F.col("doc_id").alias("row_id"), "text")
    talk = corpora.table(spark, d, "conversations").select(
        F.lit("conversations").alias("split"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return corpora.union_splits(docs, talk).select(
        "split", "row_id", F.length("text").cast("bigint").alias("n_chars"))


# Book files are composed from documents: a header by id, then the text.
block("book_files", [], """
  SELECT doc_id,
         'Title: Book ' || doc_id || ': ' || lang || chr(10)
         || CASE WHEN lang = 'es' THEN repeat('-', 1500) || chr(10) ELSE '' END
         || 'Release Date: ' || strftime(DATE '2022-06-01' + CAST(doc_id % 500 AS INTEGER), '%B %-d, %Y')
         || ' [eBook #' || doc_id || ']' || chr(10)
         || 'no field here' || chr(10)
         || 'Original Publication: London: Smith, ' || (1800 + doc_id % 150) || chr(10)
         || 'TITLE : Last ' || doc_id || chr(10)
         || CASE WHEN lang = 'de' THEN '' ELSE '*** START OF THIS BOOK ***' || chr(10) END
         || text || chr(10) || CASE WHEN lang = 'fr' THEN '*** END OF PART ***' || chr(10) || 'More: text' || chr(10) ELSE '' END
         || '*** END OF THIS BOOK ***' || chr(10) || 'after' AS file,
         lang, text, DATE '2022-06-01' + CAST(doc_id % 500 AS INTEGER) AS released,
         1800 + doc_id % 150 AS year
  FROM documents""")


def book_files(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    day = F.date_add(F.lit("2022-06-01").cast("date"), (F.col("doc_id") % 500).cast("int"))
    year = (1800 + F.col("doc_id") % 150).cast("string")
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("Title: Book "), key, F.lit(": "), "lang",
        # Beyond the first thousand bytes of these, the header goes on.
        F.when(F.col("lang") == "es", "\n" + "-" * 1500).otherwise(""), F.lit("\nRelease Date: "),
        F.date_format(day, "MMMM d, yyyy"), F.lit(" [eBook #"), key, F.lit("]\nno field here\n"),
        F.lit("Original Publication: London: Smith, "), year, F.lit("\nTITLE : Last "), key, F.lit("\n"),
        F.when(F.col("lang") == "de", "").otherwise("*** START OF THIS BOOK ***\n"), "text", F.lit("\n"),
        F.when(F.col("lang") == "fr", "*** END OF PART ***\nMore: text\n").otherwise(""),
        F.lit("*** END OF THIS BOOK ***\nafter"))
    return docs.select("doc_id", "lang", text.alias("text"))


@query("a3_parse_books", """
  SELECT doc_id,
         CASE WHEN lang <> 'de' THEN 'Last ' || doc_id END AS title,
         CASE WHEN lang <> 'de' THEN 'London: Smith, ' || year END AS publication,
         CASE WHEN lang <> 'de' THEN 3 END AS n_fields,
         CASE WHEN lang <> 'de' THEN md5(text || chr(10) ||
           CASE WHEN lang = 'fr' THEN '*** END OF PART ***' || chr(10) || 'More: text' || chr(10) ELSE '' END)
         END AS body_md5,
         CASE WHEN lang = 'de' THEN 'no start mark' END AS parse_error
  FROM book_files""", ["book_files"])
def a3(spark, d):
    parsed = books.parse_books(book_files(spark, d))
    return parsed.select(
        "doc_id", F.element_at("metadata", F.lit("title")).alias("title"),
        F.element_at("metadata", F.lit("original publication")).alias("publication"),
        F.when(F.col("metadata").isNotNull(), F.size("metadata")).alias("n_fields"),
        F.md5(F.encode("body", "UTF-8")).alias("body_md5"), "parse_error")


# The first bytes as hexadecimal pairs: one character each if they are no valid UTF-8.
@query("a4_decode_header", f"""
  SELECT doc_id, coalesce(
      TRY(decode(unhex(head))),
      array_to_string(list_transform(range(0, len(head) // 2),
        lambda i: chr(CAST('0x' || substr(head, 2 * i + 1, 2) AS INTEGER))), '')) AS header
  FROM (SELECT doc_id, substr(hex(encode(text)), 1, {2 * params.HEADER_BYTES}) AS head FROM documents)""")
def a4(spark, d):
    files = documents(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.select("doc_id", books.decode_header(F.col("content")).alias("header"))


@query("a5_save_corpus", """
  SELECT doc_id, lang, len(w)::INTEGER AS n_tokens,
         (SELECT count(*) FROM documents) AS n_rows FROM split""", ["split"])
def a5(spark, d):
    docs = documents(spark, d).select("doc_id", "lang", F.size(tk.words("text")).alias("n_tokens"))
    path = run_folder(spark, "saved_corpus")
    sinks.save_corpus(docs, path, max_records=1_000_000)
    saved = spark.read.parquet(path)
    return saved.withColumn("n_rows", saved.agg(F.count("*")).scalar())


@query("a6_write_run", """
  SELECT 'probe' AS experiment_name, source, count(*) AS n_docs, '42' AS seed
  FROM documents GROUP BY source""")
def a6(spark, d):
    per = corpora.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_docs"))
    path = run_folder(spark, "runs")
    sinks.write_run(spark, "probe", {"seed": params.SEED}, {"sources": per}, path)
    seed = sinks.read_run(spark, "run_params", path, "probe").filter("key = 'seed'")
    return sinks.read_run(spark, "sources", path, "probe").withColumn(
        "seed", seed.select("value").scalar())


@query("a8_write_scores", """
  SELECT doc_id, length(text) AS n_chars FROM documents""")
def a8(spark, d):
    path = run_folder(spark, "scores")
    rows = corpora.table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    sinks.write_scores(rows, path)
    return spark.read.parquet(path)


# ---------------------------------------------------------- dates and years


@query("b1_release_date", """
  SELECT doc_id, released AS release_date FROM book_files""", ["book_files"])
def b1(spark, d):
    header = books.header_of(F.encode("text", "UTF-8"))
    return book_files(spark, d).select("doc_id", books.release_date(header).alias("release_date"))


@query("b2_release_date_strict", """
  SELECT doc_id, released AS release_date FROM book_files WHERE lang <> 'de'""", ["book_files"])
def b2(spark, d):
    parsed = books.parse_books(book_files(spark, d)).filter("parse_error IS NULL")
    return parsed.select("doc_id", books.release_date_strict(
        books.field(books.RELEASE_FIELD)).cast("date").alias("release_date"))


@query("b3_released_after", f"""
  SELECT doc_id, released AS release_date FROM book_files
  WHERE released > DATE '{params.RELEASE_CUTOFF}'""", ["book_files"])
def b3(spark, d):
    return books.released_after(b1(spark, d))


YEAR_SQL = books.YEAR_PATTERN


@query("b4_publication_year", rf"""
  SELECT doc_id, nullif(regexp_extract('London: Smith, ' || year, '{YEAR_SQL}', 1), '') AS header_year,
         nullif(regexp_extract(text, '{YEAR_SQL}', 1), '') AS text_year
  FROM book_files""", ["book_files"])
def b4(spark, d):
    docs = documents(spark, d)
    header = F.concat(F.lit("London: Smith, "), (1800 + F.col("doc_id") % 150).cast("string"))
    return docs.select("doc_id", books.publication_year(header).alias("header_year"),
                       books.publication_year(F.col("text")).alias("text_year"))


@query("b5_filter_year", f"""
  SELECT doc_id, CAST(year AS VARCHAR) AS original_publication FROM book_files
  WHERE year BETWEEN {params.YEAR_LO} AND {params.YEAR_HI}""", ["book_files"])
def b5(spark, d):
    docs = corpora.table(spark, d, "documents").select(
        "doc_id", (1800 + F.col("doc_id") % 150).cast("string").alias("original_publication"))
    return sp.filter_year(docs, "original_publication")


@query("b6_min_tokens", f"""
  SELECT doc_id, n_tokens::INTEGER AS n_tokens FROM lengths WHERE n_tokens > {params.MIN_TOKENS}""", ["lengths"])
def b6(spark, d):
    return sp.min_tokens(tk.doc_lengths(documents(spark, d)))


@query("b7_projection", "SELECT doc_id, lang FROM documents")
def b7(spark, d):
    return corpora.table(spark, d, "documents").select("doc_id", "lang")


@query("b8_select_ids", """
  SELECT -l.doc_id AS ordinal, d.doc_id, d.n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id
  ORDER BY ordinal""")
def b8(spark, d):
    ids = corpora.table(spark, d, "labels").select((-F.col("doc_id")).alias("ordinal"), "doc_id")
    docs = corpora.table(spark, d, "documents").select("doc_id", "n_chars")
    return sp.select_ids(docs, ids).select("ordinal", "doc_id", "n_chars")


@query("b9_first_n", """
  SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 400""")
def b9(spark, d):
    return sp.first_n(corpora.table(spark, d, "documents").select("doc_id", "n_chars"), 400)


@query("b10_id_range_and_list", """
  SELECT 'range' AS kind, doc_id FROM documents WHERE doc_id >= 100 AND doc_id < 700
  UNION ALL SELECT 'list', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def b10(spark, d):
    docs = corpora.table(spark, d, "documents").select("doc_id")
    named = sp.id_list(docs, corpora.table(spark, d, "labels"))
    return sp.id_range(docs, 100, 700).select(F.lit("range").alias("kind"), "doc_id").unionByName(
        named.select(F.lit("list").alias("kind"), "doc_id"))


@query("b11_name_contains", """
  SELECT doc_id FROM documents WHERE contains(lower(text), lower('ThAt aNd'))""")
def b11(spark, d):
    return sp_names(spark, d).select("doc_id")


# Many names at once: the first two words of every benchmark text.
@query("b11_any_of_many", """
  SELECT doc_id FROM documents d WHERE EXISTS (
    SELECT 1 FROM (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+')) AS q FROM benchmark)
    WHERE q <> '' AND contains(lower(d.text), q))""")
def b11_many(spark, d):
    docs = corpora.table(spark, d, "documents").select("doc_id", F.col("text").alias("name"))
    asked = corpora.table(spark, d, "benchmark").select(
        F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0).alias("query"))
    return catalogue.name_contains_any(docs, asked, "doc_id").select("doc_id")


def sp_names(spark, d):
    docs = corpora.table(spark, d, "documents").select("doc_id", F.col("text").alias("name"))
    return catalogue.name_contains(docs, "ThAt aNd")


# ------------------------------------------------------------------- pages
# Record blocks and links are added to the stored pages by page id.

block("book_pages", [], r"""
  SELECT page_id, url, html
    || '<div data-id="bibrec">decoy<td itemprop="interactionCount">9 downloads</td></div>'
    || '<div class="x" id="bibrec"><div><DIV>inner</DIV> note</div><table>'
    || CASE WHEN page_id % 7 = 0 THEN '' ELSE '<tr property="dcterms:language"><th>Language</th><td>'
         || CASE WHEN page_id % 3 = 0 THEN 'French' ELSE 'English, French' END || '</td></tr>' END
    || '<tr><td itemprop="headline">A &amp; B' || chr(10) || page_id || '</td></tr>'
    || '<tr><td>' || CASE WHEN page_id % 5 = 0 THEN '' ELSE '<a href="/a/1" itemprop="creator">Author, ' || page_id || '</a>' END || '</td></tr>'
    || '<tr><td itemprop="datePublished">Mar ' || (1 + page_id % 28) || ', 2023</td></tr>'
    || CASE WHEN page_id % 4 = 0 THEN '' ELSE '<tr><td itemprop="interactionCount">' || page_id || ' downloads in the last 30 days.</td></tr>' END
    || '</table></div>'
    || '<a href="/f/' || page_id || '.htm" class="link">Read as HTML</a>'
    || CASE WHEN page_id % 2 = 0 THEN '<a href="/f/' || page_id || '-0.txt" class="link">Plain Text</a><a class="big link" href="/f/' || page_id || '-8.txt">Plain Text UTF-8</a>' ELSE '' END
    || '<a href="/f/other.txt" class="linked">Plain Text</a>'
    || '<ol><li><a href="/ebooks/' || page_id || '">Book one</a></li><li><a href="/ebooks/' || (page_id + 1)
    || '">Book two</a></li><li><b>no link</b></li><li><a href="/ebooks/' || (page_id + 2) || '">Book one</a></li></ol>' AS html
  FROM pages""")


def book_pages(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    every = lambda n: F.col("page_id") % n == 0
    parts = [
        "html", F.lit('<div data-id="bibrec">decoy<td itemprop="interactionCount">9 downloads</td></div>'
                      '<div class="x" id="bibrec"><div><DIV>inner</DIV> note</div><table>'),
        F.when(every(7), "").otherwise(F.concat(
            F.lit('<tr property="dcterms:language"><th>Language</th><td>'),
            F.when(every(3), "French").otherwise("English, French"), F.lit("</td></tr>"))),
        F.lit('<tr><td itemprop="headline">A &amp; B\n'), key, F.lit("</td></tr><tr><td>"),
        F.when(every(5), "").otherwise(F.concat(
            F.lit('<a href="/a/1" itemprop="creator">Author, '), key, F.lit("</a>"))),
        F.lit('</td></tr><tr><td itemprop="datePublished">Mar '),
        (1 + F.col("page_id") % 28).cast("string"), F.lit(", 2023</td></tr>"),
        F.when(every(4), "").otherwise(F.concat(
            F.lit('<tr><td itemprop="interactionCount">'), key,
            F.lit(" downloads in the last 30 days.</td></tr>"))),
        F.lit('</table></div><a href="/f/'), key, F.lit('.htm" class="link">Read as HTML</a>'),
        F.when(every(2), F.concat(
            F.lit('<a href="/f/'), key, F.lit('-0.txt" class="link">Plain Text</a><a class="big link" href="/f/'),
            key, F.lit('-8.txt">Plain Text UTF-8</a>'))).otherwise(""),
        F.lit('<a href="/f/other.txt" class="linked">Plain Text</a><ol><li><a href="/ebooks/'), key,
        F.lit('">Book one</a></li><li><a href="/ebooks/'), (F.col("page_id") + 1).cast("string"),
        F.lit('">Book two</a></li><li><b>no link</b></li><li><a href="/ebooks/'),
        (F.col("page_id") + 2).cast("string"), F.lit('">Book one</a></li></ol>'),
    ]
    return corpora.text_table(spark, d, "pages", "page_id").select(
        "page_id", "url", F.concat(*parts).alias("html"))


def plain_sql(expr: str) -> str:
    out = f"regexp_replace({expr}, '{catalogue.TAG_PATTERN}', '', 'g')"
    for name, sign in catalogue.ENTITIES.items():
        out = f"replace({out}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return out


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# What the record blocks hold follows from the page id, so these twins parse nothing but the stored title.
block("page_facts", [], """
  SELECT page_id,
         CASE WHEN contains(html, '<title>') THEN replace(replace(replace(split_part(split_part(
           html, '<title>', 2), '</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') END AS title,
         CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'LanguageFrench' ELSE 'English' END AS language,
         CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id END::INTEGER AS downloads
  FROM pages""")
block("bib", [], """
  SELECT page_id,
         CASE WHEN page_id % 5 > 0 THEN 'A & B' || page_id END AS bib_title,
         CASE WHEN page_id % 5 > 0 THEN 'Author, ' || page_id END AS bib_author,
         CASE WHEN page_id % 5 > 0 THEN 'Mar ' || (1 + page_id % 28) || ', 2023' END AS bib_published
  FROM pages""")


@query("a7_metadata_lines", """
  SELECT page_id, bib_title || chr(9) || bib_published || ',' || chr(9) || bib_author AS line
  FROM bib WHERE bib_title IS NOT NULL""", ["bib"])
def a7(spark, d):
    return catalogue.page_bib(book_pages(spark, d)).filter("bib_title IS NOT NULL").select(
        "page_id", catalogue.metadata_line().alias("line"))


@query("b12_page_metadata", "SELECT page_id, title, language FROM page_facts", ["page_facts"])
def b12(spark, d):
    return catalogue.page_metadata(book_pages(spark, d)).select("page_id", "title", "language")


@query("b13_page_downloads", "SELECT page_id, downloads FROM page_facts", ["page_facts"])
def b13(spark, d):
    return catalogue.page_downloads(book_pages(spark, d)).select("page_id", "downloads")


@query("b14_page_bib", "SELECT page_id, bib_title, bib_author, bib_published FROM bib", ["bib"])
def b14(spark, d):
    return catalogue.page_bib(book_pages(spark, d)).select("page_id", "bib_title", "bib_author", "bib_published")


@query("b15_eligible_pages", """
  SELECT page_id, title, downloads FROM page_facts WHERE language = 'English' AND downloads >= 100""",
       ["page_facts"])
def b15(spark, d):
    facts = catalogue.page_downloads(catalogue.page_metadata(book_pages(spark, d)))
    return catalogue.eligible_pages(facts, min_downloads=100).select("page_id", "title", "downloads")


@query("b16_pick_link", f"""
  SELECT page_id, coalesce(max(href) FILTER (plain_rank = 1), max(href) FILTER (html_rank = 1), '') AS link
  FROM (
    SELECT page_id, href,
           CASE WHEN contains(a, 'Plain Text') THEN row_number() OVER (
             PARTITION BY page_id, contains(a, 'Plain Text') ORDER BY i DESC) END AS plain_rank,
           CASE WHEN NOT contains(a, 'Plain Text') AND contains(a, 'HTML') THEN row_number() OVER (
             PARTITION BY page_id, contains(a, 'Plain Text'), contains(a, 'HTML') ORDER BY i DESC) END AS html_rank
    FROM (
      SELECT page_id, a, i, regexp_extract(a, {quoted(catalogue.HREF_PATTERN)}, 1) AS href FROM (
        SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (
          SELECT page_id, regexp_extract_all(html, {quoted(catalogue.ANCHOR_PATTERN)}) AS l FROM book_pages))
      WHERE regexp_matches(a, {quoted(catalogue.LINK_CLASS_PATTERN)})))
  GROUP BY page_id""", ["book_pages"])
def b16(spark, d):
    return catalogue.pick_link(book_pages(spark, d)).select("page_id", "link")


LIST_ITEMS = 100  # the listing's own top-n


@query("b17_list_links", f"""
  SELECT page_id, title, arg_max(href, i) AS href FROM (
    SELECT page_id, i, {plain_sql('li')} AS title,
           regexp_extract(li, {quoted(catalogue.HREF_PATTERN)}, 1) AS href FROM (
      SELECT page_id, unnest(l) AS li, generate_subscripts(l, 1) AS i FROM (
        SELECT page_id, regexp_extract_all(html, {quoted(catalogue.ITEM_PATTERN)}) AS l FROM book_pages))
    WHERE i <= {LIST_ITEMS})
  WHERE contains(href, 'ebooks') GROUP BY page_id, title""", ["book_pages"])
def b17(spark, d):
    return catalogue.list_links(book_pages(spark, d), limit=LIST_ITEMS)


@query("c4_skip_collected", """
  SELECT page_id, title FROM page_facts f WHERE NOT EXISTS (
    SELECT 1 FROM (
      SELECT CASE page_id % 4 WHEN 0 THEN title || '.txt' WHEN 1 THEN title
                  WHEN 2 THEN replace(title, ' ', '_') || '.txt' ELSE title || '.htm' END AS name
      FROM page_facts) h
    WHERE h.name IN (f.title || '.txt', f.title, replace(f.title, ' ', '_') || '.txt'))""", ["page_facts"])
def c4(spark, d):
    pages = corpora.text_table(spark, d, "pages", "page_id")
    titles = catalogue.page_metadata(pages).select("page_id", "title")
    kind = F.col("page_id") % 4
    name = F.when(kind == 0, F.concat("title", F.lit(".txt"))).when(kind == 1, F.col("title")).when(
        kind == 2, F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit(".txt"))).otherwise(
        F.concat("title", F.lit(".htm")))
    return catalogue.skip_collected(titles, titles.select(name.alias("name")))


# ---------------------------------------------------------------- sampling


@query("c1_sample_n", f"""
  SELECT doc_id, rank FROM (
    SELECT doc_id, row_number() OVER (ORDER BY md5('{params.SEED}:' || doc_id), doc_id) AS rank FROM documents)
  WHERE rank <= 150""")
def c1(spark, d):
    docs = corpora.table(spark, d, "documents").select("doc_id")
    return sp.sample_n(docs, 150).select("doc_id", F.col("rank").cast("bigint").alias("rank"))


def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    rows = tk.doc_lengths(documents(spark, d), ["si"])
    return sp.split_chunks(rows.filter(is_member()), rows.filter(is_non_member()))


@query("c2_split_chunks", "SELECT doc_id, chunk_id, row_in_chunk, label FROM chunks", ["chunks"])
def c2(spark, d):
    return chunk_table(spark, d)


# Chunks of the documents of either class that a date column of their own puts between two years.
block("dcls", ["lengths"], f"""
  SELECT doc_id, CASE WHEN si < 8 THEN 1 ELSE 0 END AS label FROM lengths
  WHERE si < 16 AND n_tokens > {params.MIN_TOKENS}
    AND CASE WHEN si < 8 THEN 1800 + doc_id % 150 ELSE 1780 + doc_id % 170 END
        BETWEEN {params.YEAR_LO} AND {params.YEAR_HI}""")
block("dper", ["dcls"], f"""
  SELECT CAST(floor(min(n) / {params.N_CHUNKS}) AS BIGINT) AS p FROM (SELECT count(*) AS n FROM dcls GROUP BY label)""")


@query("c2_dated_chunks", f"""
  SELECT doc_id, CAST((rn - 1) // p AS INTEGER) AS chunk_id,
         CAST((rn - 1) % p + CASE WHEN label = 0 THEN p ELSE 0 END AS INTEGER) AS row_in_chunk, label
  FROM (SELECT *, row_number() OVER (PARTITION BY label
                  ORDER BY md5('{params.SEED}:' || doc_id), doc_id) AS rn FROM dcls), dper
  WHERE rn <= {params.N_CHUNKS} * p""", ["dcls", "dper"])
def c2_dated(spark, d):
    rows = tk.doc_lengths(documents(spark, d), ["si"])
    year = lambda base, span: (base + F.col("doc_id") % span).cast("string")
    return sp.dated_chunks(rows.filter(is_member()).withColumn("publication_date", year(1800, 150)),
                           rows.filter(is_non_member()).withColumn("original_publication", year(1780, 170)))


@query("c3_label_classes", """
  SELECT doc_id, CASE WHEN si < 8 THEN 1 ELSE 0 END AS label FROM split WHERE si < 16""", ["split"])
def c3(spark, d):
    docs = documents(spark, d).select("doc_id", "si")
    return sp.label_classes(docs.filter(is_member()), docs.filter(is_non_member())).select("doc_id", "label")


@query("c8_random_split", f"""
  SELECT doc_id, CASE WHEN rn <= ceil((SELECT count(*) FROM documents) * CAST({params.TEST_SHARE} AS DOUBLE))
                      THEN 'test' ELSE 'train' END AS role
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('{params.SEED}:' || doc_id), doc_id) AS rn
        FROM documents)""")
def c8(spark, d):
    return sp.random_split(corpora.table(spark, d, "documents").select("doc_id"))


@query("c7_with_labels", """
  SELECT n.doc_id, n.n_tokens::INTEGER AS n_tokens, l.quality AS label
  FROM lengths n JOIN labels l USING (doc_id)""", ["lengths"])
def c7(spark, d):
    labels = corpora.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return sp.with_labels(tk.doc_lengths(documents(spark, d)), labels)
