"""Text rules over ``documents``, ``plot_chunk`` and fixed phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanzaku.functions import text as T
from tanzaku.operators import chunking as C
from tanzaku.operators import pages as G
from tanzaku.operators import routing as Q
from tanzaku.plans.registry import query
from tanzaku.plans.selecting import PROFILE, works
from tanzaku.tables import load

TODAY = "2026-08-21"
#: Phrases and the quarter they mean on ``TODAY``.
PHRASES = [
    ("2016年7月番有哪些", 201607), ("2016 年 8 月的番", 201607), ("2016年夏季番", 201607), ("2016年有哪些番", 201607), ("十年前的这个季度在播什么", 201607),
    ("三年前的秋番", 202310), ("去年冬番有哪些", 202501), ("今年春季有什么新番", 202604), ("上一季有哪些番", 202604), ("这个季度在播什么", 202607), ("下一季有什么新番", 202610),
    ("下下季有什么番", 202701), ("2016年的作画怎么样", None), ("《进击的巨人》的结局是什么", None), ("花泽香菜配过哪些角色", None),
]
#: Questions in which the rules fire, or nearly do; the held-out questions hardly ever ask for people, studios or songs.
QUESTIONS = (
    "花泽香菜配过哪些角色", "钉宫理惠配了什么角色", "樱井孝宏的配音作品有哪些", "银魂里神乐是谁配的", "这个角色的声优是谁", "路飞的CV是谁", "银魂里神乐是谁配的角色", "声优花泽香菜有哪些角色", "《进击的巨人》里有哪些角色", "宫崎骏的代表作是什么",
    "推荐几部科幻番", "《进击的巨人》的结局是什么", "十年前的这个季度在播什么", "2016年7月番有哪些", "2016年的作画怎么样", "给我推荐点像命运石之门的", "花泽香菜今年有哪些新番", "导演还做过什么", "原作和人设是谁", "制作公司是哪家", "还有什么作品", "作曲是谁", "片头曲是什么", "OP 是谁唱的", "TOP 10", "监督最后怎么样了",
)
def _values(rows, cols: str) -> str:
    show = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") t({cols})"


@query(_values(PHRASES, "phrase, ym"))
def parse_quarter_phrases(spark, d):
    df = spark.createDataFrame([(p,) for p, _ in PHRASES], "phrase string")
    return df.select("phrase", Q.parse_quarter(F.col("phrase"), F.lit(TODAY).cast("date")).cast("int").alias("ym"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """item_id, question: all held-out questions, and ``QUESTIONS`` under numbers below zero."""
    q = load(spark, d, "eval_item", ["item_id", "question"])
    return q.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(QUESTIONS)], "item_id long, question string"))


ASKED = "asked as (select item_id, question, lower(question) q from eval_item union all select n, t, lower(t) from (values " + ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(QUESTIONS)) + ") v(n, t))"
_has = lambda words, q="q": f"regexp_matches({q}, '{'|'.join(words)}')"
VOICE_SQL = f"case when {_has(Q.CHARACTER_TRIGGERS)} then 'character' when {_has(('配过', '配了', '配音作品'))} or {_has(Q.PERSON_TRIGGERS)} and {_has(Q.VOICE_WORDS)} then 'person' end"


@query(f"""with {ASKED}, r as (select item_id, {', '.join(f"{_has(w, 'question')} r{i}" for i, w in enumerate(Q.ROLE_TRIGGERS.values()))}, {_has(Q.STUDIO_TRIGGERS, 'question')} st, {_has(Q.GENERIC_TRIGGERS, 'question')} g, {VOICE_SQL} voice from asked),
l as (select *, concat_ws(',', {', '.join(f"case when r{i} then '{role}' end" for i, role in enumerate(Q.ROLE_TRIGGERS))}) ro from r)
select item_id, case when ro = '' and not st and g then '原作,导演' else ro end roles, st or (ro = '' and g) studio, voice from l""")
def question_intents(spark, d):
    roles, studio = Q.relation_intent(F.col("question"))
    return asked(spark, d).select("item_id", roles.alias("roles"), studio.alias("studio"), Q.voice_intent(F.col("question")).alias("voice"))


@query(f"""with {ASKED}, r as (select item_id, question, {VOICE_SQL} voice, {_has(Q.SEASON_TRIGGERS, 'question')} as triggered,
regexp_matches(question, '[0-9]{{4}}\\s*年') or regexp_matches(question, '([0-9一二两三四五六七八九十]+)\\s*年前|今年|本年|去年|前年|明年|下下季|下一季|下个季度|下一个季度|下季|上一季|上个季度|上一个季度|上季|这个季度|本季|当季|这一季') as quarters from asked)
select item_id, case when voice = 'person' then 'voice' when triggered and quarters then 'season' else 'ask' end route from r""")
def route_classify(spark, d):
    return asked(spark, d).select("item_id", Q.route(F.col("question"), F.lit(TODAY).cast("date")).alias("route"))


@query("select doc_id, round(len(regexp_extract_all(text, '[ぁ-んァ-ヶ]')) / greatest(length(text), 1), 6) kana, len(regexp_extract_all(text, '[ぁ-んァ-ヶ]')) / greatest(length(text), 1) > 0.2 japanese from documents")
def kana_ratio(spark, d):
    x = load(spark, d, "documents", ["doc_id", "text"])
    return x.select("doc_id", F.round(T.class_share(F.col("text"), T.KANA), 6).alias("kana"), T.is_japanese(F.col("text")).alias("japanese"))


SHARE = "len(regexp_extract_all({0}, '[ぁ-んァ-ヶ]')) / greatest(length({0}), 1)"


@query(f"""with t as (select subject_id, min(summary) s from anime_profile where summary is not null group by 1), b as (select subject_id, s, regexp_split_to_array(s, '\\n\\s*\\n') bl from t),
k as (select subject_id, s, trim(array_to_string(bl[1:coalesce(list_max(list_transform(range(1, len(bl) + 1), lambda i: case when {SHARE.format('bl[i]')} <= 0.08 then i else 0 end)), 0)], chr(10) || chr(10)), ' ') kept from b)
select subject_id, md5(case when {SHARE.format('s')} > 0.03 and length(kept) >= 8 and {SHARE.format('kept')} <= 0.05 and length(kept) >= 0.15 * length(s) then kept else s end) digest from k""")
def strip_tail_blocks(spark, d):
    t = load(spark, d, "anime_profile", ["subject_id", "summary"]).where("summary is not null").groupBy("subject_id").agg(F.min("summary").alias("s"))
    return t.select("subject_id", F.md5(T.without_tail(F.col("s"))).alias("digest"))


@query()
def chunk_pack(spark, d):
    return C.chunk_texts(load(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


@query()
def chunk_size_stats(spark, d):
    c = C.chunk_texts(load(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")
    n = F.length("chunk")
    return c.agg(F.count("*").alias("chunks"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.max(n).alias("longest"), F.count_if(n > C.MOST).alias("over"))


@query("""with c as (select distinct chunk_id, section, text from plot_chunk), k as (select chunk_id, case when regexp_matches(coalesce(section, ''), '(?i)主题曲|主題曲|片头曲|片尾曲|片頭曲|插曲|OP$|ED$|歌曲|曲目|音乐|音樂|BGM|角色歌') then 'songs'
when regexp_matches(coalesce(section, ''), '(?i)CAST|STAFF|声优|聲優|配音|演员|演職員|職員|制作人员|製作人員|工作人员') then 'credits' when regexp_matches(coalesce(section, ''), '各话|各話|各集|话数|話數|分集|集数|集數|剧集|劇集|集标题|集標題|标题列表|標題列表') then 'episodes'
when regexp_matches(coalesce(section, ''), '单行本|單行本|发售|發售|商品|周边|BD|DVD|蓝光') then 'goods' when regexp_matches(coalesce(section, ''), '攻略|流程图|流程圖|路线图|路線圖|存档点|存檔點') then 'guide'
when len(regexp_extract_all(text, 'CV[.:：]|作词|作曲|编曲|演唱[:：]|作詞|編曲')) >= 3 then 'credits' else 'prose' end kind from c) select kind, count(*) n from k group by 1""")
def kind_classify(spark, d):
    c = load(spark, d, "plot_chunk", ["chunk_id", "section", "text"]).distinct()
    return c.groupBy(C.kind_of(F.col("section"), F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """page, pageid, html: pages made of up to 64 chunks of one page each, to be read back; every chunk is a section of its own, with its number as link."""
    c = load(spark, d, "plot_chunk", ["chunk_id", "pageid", "section", "text", "chunk_no", "heimu_chars"]).where("pageid is not null").distinct()
    clean = F.regexp_replace("text", "[<>&]", " ")
    cut = F.least(F.coalesce("heimu_chars", F.lit(0)), F.length("text"))
    text = F.concat(F.lit('<span class="heimu">'), F.left(clean, cut), F.lit("</span>"), F.substring(clean, cut + 1, F.length("text")))
    one = F.concat(F.lit('<section data-mw-section-id="'), F.col("chunk_id").cast("string"), F.lit('"><h2>'), F.coalesce("section", F.lit("")), F.lit("</h2><p>"), text, F.lit('</p><a href="/'), F.col("chunk_no").cast("string"), F.lit('">x</a></section>'))
    page = F.concat_ws("-", "pageid", F.floor(F.col("chunk_id") / 64))
    return c.groupBy(page.alias("page"), "pageid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", one.alias("h")))), lambda x: x["h"]), "").alias("html"))  # 64 chunks at most


@query()
def html_sections(spark, d):
    return G.html_sections(pages(spark, d), "page", "html")


@query()
def page_chunks(spark, d):
    return G.page_chunks(pages(spark, d), "page", "html")


@query("select distinct pageid, chunk_no::varchar link from plot_chunk where pageid is not null")
def html_links(spark, d):
    return pages(spark, d).select("pageid", F.explode(C.links(F.col("html"))).alias("link")).distinct()


@query("select chunk_id, len(regexp_extract_all(text, '[一-鿿]')) cjk, length(text) // 40 + 1 cells, len(regexp_extract_all(text, '[一-鿿]')) >= 40 and length(text) // 40 + 1 <= 40 and len(regexp_extract_all(text, '[一-鿿]')) / (length(text) // 40 + 1) >= 60 as keep from (select distinct chunk_id, text from plot_chunk)")
def table_keep_rule(spark, d):
    c = load(spark, d, "plot_chunk", ["chunk_id", "text"]).distinct()
    c = c.select("chunk_id", F.regexp_count("text", F.lit("[一-鿿]")).cast("long").alias("cjk"), (F.floor(F.length("text") / 40) + 1).cast("long").alias("cells"))
    return c.withColumn("keep", C.keeps_table(F.col("cjk"), F.col("cells")))


@query("select distinct chunk_id, heimu_chars, case when heimu_chars > 0 or spoiler_box then 1 else 0 end as lvl from plot_chunk")
def spoiler_attribution(spark, d):
    c = load(spark, d, "plot_chunk", ["chunk_id", "heimu_chars", "spoiler_box"]).distinct()
    return c.select("chunk_id", "heimu_chars", C.spoiler_level(F.col("heimu_chars"), F.col("spoiler_box")).alias("lvl"))


@query("with t as (select pageid, min(title) title from moegirl_page group by 1) select pageid, regexp_replace(regexp_replace(title, '[（(][^（）()]*[）)]\\s*$', ''), '^(TV动画|动画)\\s*', '') base, replace(replace(title, '！', '!'), '：', ':') narrow from t")
def title_variants(spark, d):
    t = load(spark, d, "moegirl_page", ["pageid", "title"]).groupBy("pageid").agg(F.min("title").alias("title"))
    base = F.regexp_replace(F.regexp_replace("title", r"[（(][^（）()]*[）)]\s*$", ""), r"^(TV动画|动画)\s*", "")
    return t.select("pageid", base.alias("base"), F.translate("title", "！：", "!:").alias("narrow"))


WIKI = "{{Infobox\n|中文名= 星海\n|别名={\n[海の星]\n[Star Sea]\n}\n|导演= 某人\n}}"


@query(f"select '中文名' field, '星海' as value union all select '别名', '海の星/Star Sea' union all select '导演', '某人'")
def wiki_field_extract(spark, d):
    one = spark.createDataFrame([(WIKI,)], "wiki string")
    field = lambda name: F.trim(F.regexp_extract("wiki", rf"\|\s*{name}\s*=\s*([^\r\n|}}]+)", 1))
    many = F.array_join(F.regexp_extract_all(F.regexp_extract("wiki", r"别名=\{([^}]*)\}", 1), F.lit(r"\[([^\]]+)\]"), F.lit(1)), "/")
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("中文名", field("中文名")), ("别名", many), ("导演", field("导演")))])))


SEGMENTS = "<<<1>>>甲乙\n<<<2>>>丙\n<<<4>>>丁"


@query("select * from (values (1, '甲乙'), (2, '丙'), (4, '丁')) t(n, part)")
def segment_parse(spark, d):
    one = spark.createDataFrame([(SEGMENTS,)], "reply string")
    hits = F.arrays_zip(F.regexp_extract_all("reply", F.lit(r"<<<(\d+)>>>([^<]*)"), F.lit(1)).alias("n"), F.regexp_extract_all("reply", F.lit(r"<<<(\d+)>>>([^<]*)"), F.lit(2)).alias("part"))
    return one.select(F.inline(hits)).select(F.col("n").cast("int").alias("n"), F.trim(F.regexp_replace("part", r"\s+$", "")).alias("part"))


@query("with c as (select distinct chunk_id, section, text from plot_chunk) select chunk_id, length(case when section is null then text else '【' || section || '】' || text end) n, left(text, 300) = text short from c")
def context_format(spark, d):
    c = load(spark, d, "plot_chunk", ["chunk_id", "section", "text"]).distinct()
    shown = F.concat(F.coalesce(F.concat(F.lit("【"), "section", F.lit("】")), F.lit("")), F.col("text"))
    return c.select("chunk_id", F.length(shown).cast("long").alias("n"), (F.left("text", F.lit(300)) == F.col("text")).alias("short"))


@query("with e as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) select user_id, string_agg(left(event_type, 4), '>' order by r desc) history from e where r <= 3 group by 1")
def history_window(spark, d):
    from pyspark.sql import Window

    e = load(spark, d, "events", ["user_id", "event_id", "ts", "event_type"])
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = e.withColumn("r", F.row_number().over(w)).where("r <= 3")
    g = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("r", F.left("event_type", F.lit(4)).alias("x"))), False).alias("l"))  # three entries
    return g.select("user_id", F.array_join(F.transform("l", lambda y: y["x"]), ">").alias("history"))


STRIPPED = r"regexp_replace(lower({}), '[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '', 'g')"


@query(f"with p as ({PROFILE}), k as (select subject_id, {STRIPPED.format('summary')} s, {STRIPPED.format("coalesce(name, '')")} a, {STRIPPED.format("coalesce(name_cn, '')")} b from p where summary is not null) select subject_id, s = a or (length(s) <= 12 and (contains(s, a) or contains(a, s))) or s = b or (length(s) <= 12 and (contains(s, b) or contains(b, s))) echo from k")
def name_echo_filter(spark, d):
    w = works(spark, d, ["name", "name_cn", "summary"]).where("summary is not null")
    k = w.select("subject_id", T.stripped_key(F.col("summary")).alias("s"), T.stripped_key(F.coalesce("name", F.lit(""))).alias("a"), T.stripped_key(F.coalesce("name_cn", F.lit(""))).alias("b"))
    echo = lambda n: (F.col("s") == F.col(n)) | ((F.length("s") <= 12) & (F.contains(F.col("s"), F.col(n)) | F.contains(F.col(n), F.col("s"))))
    return k.select("subject_id", (echo("a") | echo("b")).alias("echo"))
