"""How a translator or assistant declines to answer, told by phrases in four languages."""

from __future__ import annotations

import functools
import re

import ahocorasick

# How a translator or assistant declines, per language; matched in lower case.
REFUSALS = (
    r"\b(?:can(?:no|')t|cannot|unable to|not able to|won't|will not|must decline to|decline to|refuse to|have to decline)\b.{0,40}\b(?:translat|render|process|assist|provide|fulfil|comply|continue|complete|help with (?:this|that|your))",
    r"\bagainst my (?:guidelines|rules|polic)", r"\b(?:do not|don't) have enough context\b.{0,60}\b(?:not|unable)\b", r"\bas an? (?:\w+ ){0,2}(?:assistant|model)\b",
    r"\b(?:i must|i have to|i) (?:decline|refuse)\b",
    r"\bkann ich (?:leider )?nicht (?:übersetzen|bearbeiten|helfen|erfüllen|verarbeiten)\b", r"\bich (?:kann|darf|werde)\b.{0,60}\bnicht (?:übersetzen|bearbeiten|helfen|erfüllen|verarbeiten|fortfahren)\b", r"\bdarf ich .{0,40}\bnicht (?:bearbeiten|übersetzen|verarbeiten)\b", r"\b(?:gegen|nicht mit) meine[nr]? (?:richtlinien|regeln)",
    r"\bübersetzung\b.{0,40}\b(?:ablehnen|verweigern)\b", r"\blehne ich\b.{0,60}\bab\b", r"\bals (?:sprach|ki-?)?\w*assistent\b", r"\bfehlt (?:mir )?(?:der|genügend) kontext\b",
    r"\bno (?:puedo|podemos|me es posible|soy capaz de|debo) (?:traducir|procesar|ayudar(?:le|te)? con (?:esta|esa|su) (?:petición|solicitud)|continuar|proporcionar|completar|cumplir)", r"\b(?:contra|en contra de) mis (?:normas|directrices|reglas|políticas)", r"\brechazar la traducción\b", r"\bme niego a\b", r"\bcomo (?:asistente|modelo) de\b",
    r"\b(?:no (?:tengo|dispongo de) (?:suficiente )?contexto|me falta contexto|sin contexto suficiente)\b",
    r"(?:无法|不能|不便|不可以|没法)(?:翻译|处理(?:该|此|这|本)|提供|继续|完成|协助|满足)", r"(?:拒绝|谢绝)(?:继续)?(?:翻译|处理|提供|协助)", r"(?:不符合|违反|违背)(?:了)?我的(?:使用)?(?:准则|规则|政策|指南)", r"帮不了您|无法帮(?:助|到)?您|不能帮(?:助)?您", r"作为(?:一名|一个)?(?:语言|人工智能|ai)?(?:助手|模型)", r"缺少上下文|上下文不足",
)
_REFUSAL = re.compile("|".join(REFUSALS))
# How a source itself declines or apologises; its translation is no refusal.
_DECLINING = re.compile(
    r"\b(?:sorry|cannot|can't|unable|decline|refuse|guidelines|lo siento|lo sentimos|no puedo|no podemos|rechaz|me niego|"
    r"leider|tut (?:mir|uns) leid|nicht helfen|nicht beantworten|ablehnen|verweiger)|抱歉|对不起|遗憾|无法|不能|拒绝"
)
# The same in the first person.
_DECLINING_SELF = re.compile(
    r"\b(?:i|we)(?:'m|'re| am| are)? (?:\w+ ){0,3}(?:sorry|cannot|can't|can not|unable|decline|refuse|won't)\b|\bsorry,|\bmy guidelines\b|"
    r"\b(?:lo siento|lo sentimos|no puedo|no podemos|me niego|rechazo|rechazamos|mis directrices)\b|\btut (?:mir|uns) leid\b|"
    r"\b(?:ich|wir)\b.{0,60}\b(?:nicht|ab|ablehnen|verweiger\w*)\b|我们?.{0,12}(?:无法|不能|拒绝)|抱歉|对不起"
)
_ANCHOR = re.compile(r"\d+|[A-Z][a-z]{2,}")
# Words of which every refusal has one.
REFUSAL_KEYS = (
    "can't|cannot|unable|not able|won't|will not|decline|refuse|guidelines|my rules|polic|enough context|assistant|model"
    "|nicht |richtlinien|regeln|ablehn|verweiger|lehne|assistent|kontext|no puedo|no podemos|no me es|no soy|no debo|normas"
    "|directrices|reglas|políticas|rechazar|niego|asistente|modelo|contexto|无法|不能|不便|不可以|没法|拒绝|谢绝|不符合|违反|违背|帮不了|作为|上下文"
).split("|")


@functools.cache
def _keys() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for k in REFUSAL_KEYS:
        auto.add_word(k, k)
    auto.make_automaton()
    return auto


def declines(text: str) -> bool:
    """The text has a declining phrase."""
    low = text.lower().replace("’", "'")
    return next(_keys().iter(low), None) is not None and bool(_REFUSAL.search(low))


def refuses(source: str | None, target: str) -> bool:
    """The target declines, and the source neither does nor is rendered."""
    if not declines(target):
        return False
    said = (source or "").lower().replace("’", "'")
    if not _DECLINING.search(said):
        return True
    # the source has such words in some sense: it declines itself, or the target renders it
    return not (_REFUSAL.search(said) or _DECLINING_SELF.search(said) or set(_ANCHOR.findall(source)) & set(_ANCHOR.findall(target)))
