"""Registered queries: chat flattening, responses, sentiment, HTML pages, summaries, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import environment as V
from quantloom.operators import textops as X
from quantloom.plans.fixtures_sql import ENV_NEWS, NEWS_ITEMS, PRICES, RAW_NEWS, with_
from quantloom.plans.registry import register
from quantloom.sources.tables import Tables, derive_env_news


def _q(s: str) -> str:
    return s.replace("'", "''")


_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@register("chat_flatten", f"""
select conv_id, '<s>[INST] ' || string_agg(
    case when role = 'system' and rn = 1 then '<<SYS>>' || chr(10) || text || chr(10) || '<</SYS>>' || chr(10) || chr(10)
         when role = 'user' then {_STRIP.format(x='text')}
         else ' [/INST] ' || {_STRIP.format(x='text')} || '</s><s>[INST] ' end, '' order by turn) || ' [/INST]' as prompt
from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)
group by conv_id""")
def q_chat_flatten(spark, sf_dir):
    return X.chat_flatten(Tables(spark, sf_dir).conversations)


_PROVIDER = "case conv_id % 3 when 0 then 'candidates' when 1 then 'generated_text' else 'choices' end"


@register("response_text", f"""
WITH r AS (select conv_id, turn, text, {_PROVIDER} as provider,
                  case conv_id % 3
                    when 0 then json_object('candidates', [json_object('content', json_object('parts', [json_object('text', text)]))])
                    when 1 then json_object('generated_text', text)
                    else json_object('choices', [json_object('message', json_object('role', 'assistant', 'content', text))]) end
                  as payload
           from conversations where role = 'assistant')
select conv_id, turn, provider,
       case provider when 'candidates' then payload ->> '$.candidates[0].content.parts[0].text'
                     when 'generated_text' then payload ->> '$.generated_text'
                     else payload ->> '$.choices[0].message.content' end as text
from r""")
def q_response_text(spark, sf_dir):
    """H32 over provider payloads built from the assistant turns of ``conversations``."""
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "assistant")
    provider = (F.when(F.col("conv_id") % 3 == 0, "candidates").when(F.col("conv_id") % 3 == 1, "generated_text")
                .otherwise("choices"))
    gem = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("parts"))
                                              .alias("content"))).alias("candidates")))
    tgi = F.to_json(F.struct(F.col("text").alias("generated_text")))
    oai = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
                                              .alias("message"))).alias("choices")))
    r = c.select("conv_id", "turn", provider.alias("provider"),
                 F.when(provider == "candidates", gem).when(provider == "generated_text", tgi).otherwise(oai)
                 .alias("payload"))
    return r.select("conv_id", "turn", "provider", X.response_text(F.col("payload"), F.col("provider")).alias("text"))


_LEX_SQL = "lex AS (select * from (values " + ", ".join(f"('{w}', {p})" for w, p in X.DEFAULT_LEXICON) + \
           ") t(word, polarity))"

_SENT_SQL = with_(RAW_NEWS, ENV_NEWS, NEWS_ITEMS, _LEX_SQL) + """
, w AS (select seq, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+')) as word from news_items)
, a AS (select w.seq, count(*) as n, count(*) filter (where l.polarity > 0) as n_pos,
               count(*) filter (where l.polarity < 0) as n_neg
        from w left join lex l on l.word = w.word where w.word <> '' group by 1)
, s AS (select i.seq, i.text,
               case when a.n > 0 then round(a.n_pos / a.n, 3) else 0.0 end as pos,
               case when a.n > 0 then round((a.n - a.n_pos - a.n_neg) / a.n, 3) else 0.0 end as neu,
               case when a.n > 0 then round(a.n_neg / a.n, 3) else 0.0 end as neg
        from news_items i left join a on a.seq = i.seq)
"""


def _sentiment(spark, sf_dir):
    items = V.news_items(derive_env_news(Tables(spark, sf_dir)))
    s = X.lexicon_sentiment(items, "seq", X.lexicon_df(spark))
    return items.select("seq", "text").join(s, "seq")


@register("lexicon_sentiment", _SENT_SQL + """
select seq, cast(pos as double) as pos, cast(neu as double) as neu, cast(neg as double) as neg from s""")
def q_lexicon_sentiment(spark, sf_dir):
    return _sentiment(spark, sf_dir).select("seq", "pos", "neu", "neg")


@register("sentiment_append", _SENT_SQL + """
select seq, text || ' The positive score for this news is ' || cast(cast(pos as double) as varchar)
            || '. The neutral score for this news is ' || cast(cast(neu as double) as varchar)
            || '. The negative score for this news is ' || cast(cast(neg as double) as varchar) || '.' as news
from s""")
def q_sentiment_append(spark, sf_dir):
    """Each news item with its sentiment sentences appended."""
    s = _sentiment(spark, sf_dir)
    return s.select("seq", X.sentiment_append(F.col("text"), F.col("pos"), F.col("neu"), F.col("neg")).alias("news"))


def _html_sql() -> str:
    def unesc(x):
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
            x = f"replace({x}, '{a}', '{b}')"
        return x

    def squash(x):
        return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    title = squash(unesc("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))
    h1 = squash(unesc("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')"))
    link = "regexp_extract(html, '<a [^>]*href=\"([^\"]*)\"', 1)"
    no_code = "regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    body = squash(unesc(f"regexp_replace(array_to_string(regexp_extract_all({no_code}, '(?s)<p[^>]*>(.*?)</p>', 1), ' '), '<[^>]+>', ' ', 'g')"))
    snippet = squash(unesc("regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1)"))
    return f"""
select page_id, url, title, headline, link, body from (
  select page_id, url, {title} as title, {h1} as headline, {link} as link,
         coalesce(nullif({body}, ''), {snippet}) as body
  from pages) where headline <> '' and link <> ''"""


@register("html_headline", _html_sql())
def q_html_headline(spark, sf_dir):
    out = X.html_extract(Tables(spark, sf_dir).pages)
    return out.select("page_id", "url", "title", "headline", "link", "body")


@register("summary_truncate", with_(RAW_NEWS) + """
select item_id, 'Summarize the following news within 200 tokens:' || chr(10) || coalesce(body, '') || chr(10) || 'Summary:' as request,
       substring(body, 1, 200) as summary
from raw_news""")
def q_summary_truncate(spark, sf_dir):
    """H29 + H30: summary request text and the default (truncating) summariser."""
    from quantloom.sources.tables import derive_raw_news
    n = derive_raw_news(Tables(spark, sf_dir))
    return n.select("item_id", X.summary_request(F.col("body")).alias("request"),
                    X.truncate_summary(F.col("body"), X.SUMMARY_CHARS).alias("summary"))


DEFAULT_SECTORS = "(1) Diversified Industries.\n(2) Global Markets."  # fallback text of the derived profiles


def _profile_sql() -> str:
    tmpl = X.PROFILE_TEMPLATE.replace("\n", "' || chr(10) || '")
    pre, rest = tmpl.split("{sectors}")
    mid, post = rest.split("{ticker}")
    dflt = DEFAULT_SECTORS.replace("\n", "' || chr(10) || '")
    return with_(PRICES) + f"""
, prof AS (select concat('S', cast(n.n_nationkey as varchar)) as symbol,
                  '(1) ' || n.n_name || '.' || chr(10) || '(2) ' || r.r_name || '.' as sectors
           from nation n join region r on n.n_regionkey = r.r_regionkey where n.n_nationkey % 5 <> 0)
, syms AS (select distinct symbol from prices)
select s.symbol, '{pre}' || coalesce(p.sectors, '{dflt}') || '{mid}' || s.symbol || '{post}' as profile
from syms s left join prof p on p.symbol = s.symbol"""


@register("profile_render", _profile_sql())
def q_profile_render(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n, r = t.nation, t.region
    prof = (n.join(r, n.n_regionkey == r.r_regionkey).where(F.col("n_nationkey") % 5 != 0)
            .select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"),
                    F.concat(F.lit("(1) "), F.col("n_name"), F.lit(".\n(2) "), F.col("r_name"), F.lit("."))
                    .alias("sectors")))
    syms = t.prices.select("symbol").distinct()
    return X.profile_text(syms, prof, DEFAULT_SECTORS)
