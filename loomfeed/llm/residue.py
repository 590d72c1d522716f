"""Detect template residue, filler and error-page text in place of articles.

Each line is matched with one multi-pattern automaton over whole phrases of
error pages, script, browser and access notices and filler in thirteen
languages. A sentence of which the phrases are a large part is covered as a
whole, so that names and details in a notice don't hide it. Template marks,
codes beside a notice, status lines and customary filler words are covered by
patterns beside the automaton.
Lines that a source repeats under differing texts are set aside, but never
those that matches cover: an error page that floods a source is no footer.
A line is residue if it is covered for the most part. A text is residue if
residue lines hold most of its characters. Articles that merely mention such
phrases have a low coverage, whatever any status says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..operators.timestamps import source_key
from ..runtime import spread
from .site_lines import line_keys, recurring_lines, with_listed

# Phrases of error pages, of script, browser and access notices, and of filler, by language. Whole notices, not parts of them.
PHRASES = {
    "en": """
        page not found | the page you requested | the page you were looking for | that page can't be found | we can't find the page | we can't seem to find what you were after | nothing was found at this location
        maybe try a search | the link may be broken | the page may have moved | may have been moved or deleted | this content is no longer available | this page is no longer available | this content isn't available
        access denied | access to this page has been denied | you don't have permission to access | you don't have permission to view this resource | you are not authorized | you have been blocked | why have i been blocked
        internal server error | bad gateway | gateway timeout | gateway time-out | service unavailable | service temporarily unavailable | temporarily unavailable | too many requests | rate limit exceeded | retry after
        something went wrong | an error occurred | an error has occurred | an unexpected error | please try again later | please try again in a few minutes | go back to the front page | return to the home page
        could not complete your request | the server encountered | our engineers have been told | our engineers have been notified | the site owner has been notified | if you are the owner of this site | check the error log
        error establishing a database connection | fatal error | uncaught exception | uncaught typeerror | allowed memory exhausted | allowed memory size | traceback (most recent call last) | stack trace | segmentation fault
        warning: undefined variable | notice: undefined index | warning: cannot modify header information | [object object] | your session has expired | please log in to continue | sign in to continue reading
        subscribe to continue reading | this article is for subscribers only | is down for maintenance | down for scheduled maintenance | scheduled maintenance | we'll be back soon | under construction
        please enable javascript | enable javascript to continue | enable javascript | javascript is required | javascript is disabled | javascript is not enabled | requires javascript | without javascript enabled
        this site requires javascript and cookies | you need to enable javascript | you need to enable scripts | doesn't work properly without scripts enabled | doesn't work properly without javascript enabled | turn it on to read
        switch it on in the settings | turn on javascript | please enable cookies | cookies must be enabled | enable cookies to continue | your browser is not supported | browser is out of date | unsupported browser | upgrade your browser
        see the list of supported browsers | checking your browser | just a moment... | one moment, please | this may take up to five seconds | this process is automatic | needs to review the security of your connection
        we detected unusual traffic from your network | unusual traffic from your computer network | verify you are human | verify that you are human | confirm you are not a robot | are you a robot | complete the captcha | one more step
        disable your content blocker | disable your ad blocker | ad blocker detected | turn off your ad blocker | please wait while we | loading, please wait
        lorem ipsum dolor sit amet | dummy text | not for publication | this is sample text | sample text for | placeholder text | placeholder for the | your text here | insert text here | add your text here | insert quote here
        insert image here | add image here | body copy here | click to edit this text | click here to edit | edit this paragraph | replace this paragraph with your own | replace this text | headline goes here | title goes here
        text goes here | content goes here | caption goes here | tk tk tk | to be written | content coming soon | page coming soon | hello world!
    """,
    "de": """
        seite nicht gefunden | die seite wurde nicht gefunden | die angeforderte seite | existiert nicht mehr | gibt es nicht mehr | ist nicht mehr verfügbar | der dienst ist zurzeit nicht erreichbar | zurzeit nicht erreichbar
        dienst nicht verfügbar | interner serverfehler | zugriff verweigert | zugriff auf diese seite | bitte versuchen sie es später erneut | ein fehler ist aufgetreten | ihre sitzung ist abgelaufen | wegen wartungsarbeiten
        bitte aktivieren sie javascript | bitte javascript aktivieren | javascript ist deaktiviert | javascript muss aktiviert sein | ihr browser wird nicht unterstützt | bitte aktivieren sie cookies | sind sie ein mensch
        blindtext | platzhaltertext | hier steht ihr text | hier steht bald | inhalt folgt in kürze | wird geladen
    """,
    "fr": """
        page introuvable | page non trouvée | la page demandée | la page que vous cherchez | n'existe plus | n'est plus disponible | service indisponible | temporairement indisponible | erreur interne du serveur | accès refusé | accès interdit
        une erreur est survenue | une erreur s'est produite | veuillez réessayer plus tard | votre session a expiré | en cours de maintenance | veuillez activer javascript | activez javascript | javascript est désactivé
        votre navigateur n'est pas pris en charge | veuillez activer les cookies | vérifiez que vous êtes humain | texte de remplissage | texte fictif | faux texte | votre texte ici | contenu à venir | chargement en cours
    """,
    "es": """
        página no encontrada | no se encontró la página | la página solicitada | la página que busca | ya no existe | ya no está disponible | servicio no disponible | no disponible temporalmente | error interno del servidor | acceso denegado
        acceso prohibido | se ha producido un error | ha ocurrido un error | inténtelo de nuevo más tarde | su sesión ha caducado | en mantenimiento | active javascript | activa javascript | habilite javascript | javascript está desactivado
        su navegador no es compatible | active las cookies | verifique que es humano | texto de relleno | texto de ejemplo | su texto aquí | contenido próximamente | cargando...
    """,
    "it": """
        pagina non trovata | la pagina richiesta | la pagina che cerchi | non esiste più | non è più disponibile | servizio non disponibile | errore interno del server | accesso negato | si è verificato un errore | riprova più tardi
        la sessione è scaduta | in manutenzione | abilita javascript | attiva javascript | javascript è disabilitato | il tuo browser non è supportato | abilita i cookie | verifica di essere umano | testo segnaposto | testo di esempio | caricamento in corso
    """,
    "pt": """
        página não encontrada | a página solicitada | a página que procura | já não existe | não está mais disponível | serviço indisponível | erro interno do servidor | acesso negado | ocorreu um erro | tente novamente mais tarde
        a sua sessão expirou | em manutenção | ative o javascript | habilite o javascript | ativar o javascript | o javascript está desativado | navegador não é compatível | ative os cookies | confirme que é humano | texto de exemplo | a carregar
    """,
    "nl": """
        pagina niet gevonden | de opgevraagde pagina | bestaat niet meer | is niet meer beschikbaar | dienst niet beschikbaar | interne serverfout | toegang geweigerd | er is een fout opgetreden | probeer het later opnieuw
        uw sessie is verlopen | in onderhoud | schakel javascript in | javascript is uitgeschakeld | uw browser wordt niet ondersteund | schakel cookies in | voorbeeldtekst | plaatshoudertekst | bezig met laden
    """,
    "pl": """
        nie znaleziono strony | strona nie została znaleziona | już nie istnieje | usługa niedostępna | wewnętrzny błąd serwera | odmowa dostępu | wystąpił błąd | spróbuj ponownie później | sesja wygasła | włącz javascript
        obsługa javascript jest wyłączona | przeglądarka nie jest obsługiwana | włącz obsługę plików cookie | tekst zastępczy | przykładowy tekst | trwa ładowanie
    """,
    "ru": """
        страница не найдена | запрошенная страница | больше не существует | больше не доступна | сервис недоступен | сервис временно недоступен | внутренняя ошибка сервера | доступ запрещен | доступ запрещён | произошла ошибка
        повторите попытку позже | попробуйте позже | сессия истекла | технические работы | включите javascript | javascript отключен | ваш браузер не поддерживается | включите cookie | подтвердите, что вы не робот | текст-заполнитель | идет загрузка
    """,
    "tr": """
        sayfa bulunamadı | aradığınız sayfa | artık mevcut değil | hizmet kullanılamıyor | sunucu hatası | erişim engellendi | bir hata oluştu | lütfen daha sonra tekrar deneyin | oturumunuzun süresi doldu | javascript'i etkinleştirin
        tarayıcınız desteklenmiyor | çerezleri etkinleştirin | örnek metin | yükleniyor
    """,
    "ja": """
        ページが見つかりません | お探しのページ | ページは存在しません | 現在ご利用いただけません | サービスは利用できません | サーバーエラー | アクセスが拒否されました | エラーが発生しました | しばらくしてからもう一度 | セッションの有効期限
        メンテナンス中 | javascriptを有効に | javascriptが無効 | お使いのブラウザはサポートされていません | cookieを有効に | ダミーテキスト | サンプルテキスト | 読み込み中
    """,
    "zh": """
        页面未找到 | 找不到页面 | 您访问的页面 | 页面不存在 | 已不存在 | 服务不可用 | 服务器内部错误 | 访问被拒绝 | 拒绝访问 | 发生错误 | 请稍后再试 | 会话已过期 | 系统维护 | 请启用javascript | 请开启javascript | 浏览器不受支持
        请启用cookie | 占位文本 | 示例文本 | 正在加载
    """,
    "ko": """
        페이지를 찾을 수 없습니다 | 요청하신 페이지 | 더 이상 존재하지 않습니다 | 서비스를 사용할 수 없습니다 | 서버 오류 | 접근이 거부되었습니다 | 오류가 발생했습니다 | 나중에 다시 시도 | 세션이 만료 | 점검 중 | javascript를 활성화
        자바스크립트를 활성화 | 지원되지 않는 브라우저 | 쿠키를 활성화 | 예시 텍스트 | 로딩 중
    """,
}
# Reasons that stand beside or in place of an HTTP status, and what else makes up a line of its own.
STATUS_LINES = frozenset(
    """bad request|unauthorized|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|length required|payload too large|uri too long|unsupported media type|too many requests
    |internal server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|gateway timeout|page not found|error|fehler|erreur|errore|erro|oops|loading|just a moment|please wait|redirecting|draft|draft for
    |untitled|no content|coming soon|under construction|back soon|page introuvable|access denied|something went wrong""".replace("\n", "").replace("    ", "").split("|")
)
# Words of the customary filler text and of keyboard filler.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur
    sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    test foo bar baz blah asdf qwerty xxx tk tbd todo dummy filler placeholder undefined null""".split()
)

# Closing remarks that neither make nor unmake an article.
NEUTRAL = frozenset({"thanks for reading.", "to be continued.", "more soon."})

#: Part of a line, and of a text, that residue must cover, and part of a sentence beyond which phrases cover the rest of it too.
LINE_SHARE, TEXT_SHARE, SENTENCE_SHARE = 0.5, 0.5, 0.4
#: Template marks among the words and marks of a line from which it is a template line.
MARK_SHARE = 1 / 3

_TEMPLATE = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|[$#]\{[^{}]*\}|%%\w+%%|@@\w+@@|__[A-Z][A-Z_]*__|<<[^<>]+>>|\{\w*\}|%[A-Z_]{3,}%"
    r"|\[(?:INSERT|ADD|BODY|YOUR|PLACE)\b[^\[\]]*\]|\[[A-Z ]+ (?:HERE|GOES HERE)\]|\?\?\?\w*\?\?\?|\[object Object\]"
)
_CODE = re.compile(
    r"\b(?=[0-9a-f.\-]*\d)[0-9a-f]+(?:[.\-][0-9a-f]+)*\b|\b\w+/\d+(?:\.\d+)*\b|\b\d+(?:\.\d+)*\s*(?:seconds?|minutes?|ms)?\b|\bline \d+|\b[a-z]+_\w+\b|\b[a-z]+(?:error|exception)\b", re.I
)
#: Names of a report that stand before its code.
_REPORT = re.compile(r"^\W*(?:(?:request|ray|event|trace|session|error|incident|support|reference|ticket|case)\s*(?:id|code|number|no\.?)?)\s*[:#]?\s*(?=[\w.\-]*\d)[\w.\-]+\W*$", re.I)
#: A line that is a note to its writer, holds another's place, or names a template.
_NOTE = re.compile(r"^\W*(?:(?:todo|fixme|to do|tbd)\b\s*:|placeholder (?:text )?(?:for|of)\b|(?:\w+\s+){0,3}template\W+version\W*\d[\w.]*\W*$)", re.I)
#: A note within a line, and words that stand where a value is missing; the latter count beside template marks only.
_INNER_NOTE = re.compile(r"\b(?:TODO|FIXME|TBD):(?:\s+[\w'-]+){1,6}")
_VALUES = re.compile(r"\b(?:undefined|null|NaN|TBD|TK|TODO)\b")
_STATUS = re.compile(r"[^\w\s]|\b(?:http|error|status|code|fehler|erreur|errore|erro)\b(?=.*\d)|\b\d{3}\b", re.I)
_SENTENCES = re.compile(r"[^.!?…。！？|;:]*(?:[.!?…。！？|;:]+|$)")
_MARK = re.compile(r"[{%<@\[$]|__|\?\?\?")
_WORDS = re.compile(r"[^\W\d_]+")
_STOPS = str.maketrans(".,;:!?()", "        ")
_BULLET = re.compile(r"^\s*(?:[•*»–-]|>(?=\s))\s*")


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for text in PHRASES.values():
        for line in text.strip().splitlines():
            for phrase in line.split(" | "):
                made.add_word(phrase.strip(), len(phrase.strip()))
    made.make_automaton()
    return made


_AUTOMATON: ahocorasick.Automaton | None = None


def _within_word(low: str, start: int, end: int) -> bool:
    """Whether a match begins or ends inside a word (of a script that parts words by spaces)."""
    before, after = low[start - 1 : start], low[end + 1 : end + 2]
    parted = lambda a, b: a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"
    return parted(low[start], before or " ") or parted(low[end], after or " ")


def covered(line: str) -> float:
    """Part of a line's letters and digits that template marks, notices, filler and the codes beside them cover."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _automaton()
    low = line.lower().replace("’", "'")
    if len(low) != len(line):
        line = low
    words = low.translate(_STOPS).split()
    if words and sum(map(FILLER_WORDS.__contains__, words)) >= 0.7 * len(words):
        return 1.0
    if (len(words) <= 6 and (" ".join(_STATUS.sub(" ", low).split()) in STATUS_LINES or _REPORT.search(low))) or (len(words) <= 12 and _NOTE.search(low)):
        return 1.0
    hit = bytearray(len(line))
    marks = list(_TEMPLATE.finditer(line)) if _MARK.search(line) else []
    marks += _INNER_NOTE.finditer(line)
    if marks:
        marks += _VALUES.finditer(line)
        for m in marks:
            hit[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        rest = "".join(" " if h else c for c, h in zip(line, hit, strict=True))
        if len(marks) >= MARK_SHARE * (len(marks) + len(_WORDS.findall(rest))):
            return 1.0
    told = bytearray(len(line))
    for end, size in _AUTOMATON.iter(low):
        start = end - size + 1
        if not _within_word(low, start, end):
            told[start : end + 1] = b"\1" * size
    if any(told):
        for m in _SENTENCES.finditer(low):
            solid = [i for i in range(m.start(), m.end()) if low[i].isalnum() or told[i]]
            if solid and sum(told[i] for i in solid) >= SENTENCE_SHARE * len(solid):
                told[m.start() : m.end()] = b"\1" * (m.end() - m.start())
        hit = bytearray(map(int.__or__, hit, told))
    if not any(hit):
        return 0.0
    for m in _CODE.finditer(low):
        hit[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    solid = [i for i, c in enumerate(line) if c.isalnum() or hit[i]]
    return sum(hit[i] for i in solid) / len(solid) if solid else 0.0


def coverage(text: str | None, site: str | None = None, aside: Sequence[bool] | None = None) -> float:
    """Part of a text's characters in residue lines; 0 for null and blank texts. The site's own name counts for neither side.

    ``aside`` marks the lines (those that ``\\n`` separates) that count only if they are residue.
    """
    total = bad = 0
    name = re.compile(re.escape(site.strip()), re.I) if site and site.strip() else None
    for n, whole in enumerate((text or "").split("\n")):
        for line in whole.splitlines():
            bare = _BULLET.sub("", line).strip()
            if name is not None:
                bare = name.sub("", bare).strip()
            if bare and bare.lower() not in NEUTRAL:
                residue = covered(bare) >= LINE_SHARE
                bad += len(bare) * residue
                total += len(bare) * (residue or aside is None or not aside[n])
    return bad / total if total else 0.0


def residue_articles(articles: DataFrame, *, share: float = TEXT_SHARE) -> DataFrame:
    """``article_id`` of each article whose text is residue.

    Null and blank texts, and texts of nothing but lines set aside, are no
    cases. Repeated rows are judged each, a null source is a source of its
    own; other columns are not read; an empty table gives an empty result.
    """
    narrow = articles.select("article_id", "source_id", "source_name", "published_at", "content_text")
    # A line in all of a source's few texts says nothing, nor do copies, so a line must recur in five differing texts at least.
    lines = recurring_lines(narrow, least=5, share=0.05, least_clusters=5, differing=True)
    keyed = narrow.where(~is_blank(F.col("content_text"))).select("article_id", "content_text", "source_name", F.coalesce(source_key(F.col("source_id")), F.lit("")).alias("_source"))
    marks = F.transform(line_keys(F.col("content_text")), lambda k: F.coalesce(F.array_contains("_lines", k), F.lit(False)))
    marked = with_listed(keyed, lines).select("article_id", "source_name", F.col("content_text").alias("text"), F.when(F.col("_lines").isNotNull(), marks).alias("aside"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[coverage(t, s, a) >= share for t, s, a in zip(b["text"], b["source_name"], b["aside"], strict=True)], ["article_id"]]

    return spread(marked).mapInPandas(run, "article_id long")
