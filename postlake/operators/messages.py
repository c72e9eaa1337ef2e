"""Texts of outbox rows: a chat's card, a webhook's card, a mail, the mail of a digest and the weekly summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import escape_html

BRAND = "postlake"
#: Characters of a chat's message, and postings that a digest lists, at most.
LONGEST, LISTED = 4000, 30


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))


def _said(c: Column, default: str) -> Column:
    """The text, or the default where it is missing or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _bullets(most: int, safe: bool = False) -> Column:
    shown = F.slice(F.coalesce("reasoning", F.array().cast("array<string>")), 1, most)
    return F.array_join(F.transform(shown, lambda r: F.concat(F.lit("• "), escape_html(r) if safe else r)), "\n")


def _date(default: str) -> Column:
    return F.coalesce(F.date_format("published_at", "dd/MM/yyyy"), F.lit(default))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# The wording and layout of messages, here and below.
def chat_card() -> Column:
    """HTML of a posting for a chat, at most LONGEST characters."""
    why, url = _bullets(3, safe=True), F.coalesce("url", F.lit(""))
    safe = lambda name, default: escape_html(_or(name, default))
    whole = _text(
        "🎯 <b>OPORTUNIDADE EM DESTAQUE (", F.col("score").cast("string"), "% Match)</b>\n\n",
        "💼 <b>", safe("title", "Oportunidade"), "</b>\n",
        "🏢 <b>Empresa:</b> ", safe("company", "Empresa"), "\n",
        "📍 <b>Local:</b> ", safe("location", "Brasil"), " (", _capital(safe("work_mode", "N/A")), ")\n",
        "📋 <b>Contrato:</b> ", F.upper(safe("employment_type", "N/A")), " | <b>Área:</b> ", safe("area", "Tecnologia"), "\n",
        "📅 <b>Publicação:</b> ", _date("Recente"), " | <b>Fonte:</b> ", F.upper(safe("source", "Web")), "\n",
        F.when(why == "", "").otherwise(_text("\n💡 <b>Motivos do Match:</b>\n", why, "\n")),
        F.when(url == "", "").otherwise(_text("\n🔗 <a href='", url, "'>Clique aqui para ver a vaga completa</a>\n")),
    )
    return F.substring(whole, 1, LONGEST)


def webhook_card(as_of: Column) -> Column:
    """JSON of a posting for a webhook; the colour tells the score's band."""
    why, field = _bullets(4), lambda name, value, inline=True: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))
    fields = [
        field("Empresa", _or("company", "N/A")), field("Área", _or("area", "Tecnologia")), field("Localização", _or("location", "Brasil")),
        field("Modelo", _capital(_said(F.col("work_mode"), "N/A"))), field("Tipo", F.upper(_said(F.col("employment_type"), "N/A"))),
        field("Fonte", _capital(_said(F.col("source"), "Web"))), field("Data de Publicação", _date("Não informada")),
        field("Score de Relevância", _text("**", F.col("score").cast("string"), "/100**")), F.when(why != "", field("Destaques", why, False)),
    ]
    embed = F.struct(
        _text("🎯 ", _or("title", "Nova Oportunidade")).alias("title"), F.coalesce("url", F.lit("")).alias("url"),
        F.when(F.col("score") >= 85, 0x2ECC71).when(F.col("score") >= 70, 0x3498DB).otherwise(0xE67E22).alias("color"),
        F.array_compact(F.array(*fields)).alias("fields"), F.struct(F.lit(BRAND).alias("text")).alias("footer"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"),
    )
    content = _text("🚨 **Nova Oportunidade Encontrada!** Match: **", F.col("score").cast("string"), "%**")
    return F.to_json(F.struct(content.alias("content"), F.array(embed).alias("embeds")))


def mail() -> Column:
    """struct(subject, body) of a posting."""
    of = lambda name: F.coalesce(F.col(name), F.lit(""))
    score = F.col("score").cast("string")
    shown = F.transform(F.slice(F.coalesce("reasoning", F.array().cast("array<string>")), 1, 6), lambda r: _text("<li>", r, "</li>"))
    body = _text(
        "<h2>🚨 ", of("title"), "</h2><p><b>", of("company"), "</b> — ", of("location"), " (", of("work_mode"), " / ", of("seniority"), ")</p>",
        "<p>⭐ Match: <b>", score, "%</b></p><ul>", F.array_join(shown, ""), '</ul><p><a href="', of("url"), '">Ver vaga</a></p>',
    )
    return F.struct(_text(f"[{BRAND} ", score, "%] ", of("title"), " @ ", of("company")).alias("subject"), body.alias("body"))


def digest_mail(rows: DataFrame, period: str) -> DataFrame:
    """(profile_id, subject, body) of each profile's digest; ``rows`` are those of `accounts.digest`, LISTED a profile at most, with title, company and url."""
    entry = _text("<li><b>", F.coalesce("title", F.lit("")), "</b> @ ", F.coalesce("company", F.lit("")), " — ", F.col("score").cast("string"), '% — <a href="', F.coalesce("url", F.lit("")), '">ver</a></li>')
    listed = rows.where(F.col("place") <= LISTED).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("items"))
    n = F.size("items").cast("string")
    body = _text(f"<h2>{BRAND} — resumo {period} (", n, " vagas)</h2><ul>", F.array_join(F.transform("items", lambda i: i["entry"]), ""), "</ul>")
    return listed.select("profile_id", _text(f"[{BRAND}] Resumo {period}: ", n, " vagas").alias("subject"), body.alias("body"))


def weekly_summary(report: DataFrame, totals: DataFrame, top: int = 10) -> DataFrame:
    """(profile_id, message) of a `views.weekly_report` and its totals: ``top`` postings of each profile."""
    prefix = F.when(F.col("tag") == "ATUALIZADA", "🔄 [Atualizada] ").when(F.col("tag") == "NOVA", "✨ [Nova] ").otherwise("")
    entry = _text(
        "<b>", F.col("place").cast("string"), ". ", prefix, F.coalesce("title", F.lit("")), "</b>\n   🏢 ", F.coalesce("company", F.lit("")), " | 📍 ", _capital(F.coalesce("work_mode", F.lit(""))),
        " | 🎯 <b>", F.col("score").cast("string"), "% Match</b>\n   🔗 <a href='", F.coalesce("url", F.lit("")), "'>Ver Vaga Completa</a>\n",
    )
    listed = report.where(F.col("place") <= top).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("place", entry.alias("entry")))).alias("items"))
    n = lambda c: F.col(c).cast("string")
    lines = F.concat(
        F.array(
            F.lit("📊 <b>RELATÓRIO SEMANAL DE VAGAS (7 DIAS)</b>"), F.lit("<i>Período: Últimos 7 dias</i>\n"), F.lit("📈 <b>Resumo do Mercado:</b>"),
            _text("• Vagas analisadas: <b>", n("analysed"), "</b>"), _text("• Compatíveis com seu perfil: <b>", n("compatible"), "</b>"), _text("• Novas descobertas: <b>", n("new"), "</b>"),
            _text("• Remotas: ", n("remote"), " | Híbridas: ", n("hybrid"), " | Presenciais: ", n("onsite")), _text("• Vagas de estágio: <b>", n("internships"), "</b>\n"),
            _text("🏆 <b>Top ", F.size("items").cast("string"), " Oportunidades Selecionadas:</b>\n"),
        ),
        F.transform("items", lambda i: i["entry"]),
        F.array(F.lit("<i>Envie /favoritos para consultar suas vagas salvas ou /ajuda para mais comandos.</i>")),
    )
    return totals.join(listed, "profile_id").select("profile_id", F.array_join(lines, "\n").alias("message"))
