"""Problem 1: template residue, filler text, error pages and script notices.

Method: one multi-pattern (Aho-Corasick) automaton holds the openers of placeholder markup, another the words and phrases
of errors, script notices and filler in ten languages, each with its role: a thing (page, browser, paragraph), a state
(not found, switched off, blank), a request (reload, enable, replace) or wording that tells by itself. A sentence gives
evidence if it holds telling wording, or a state or request together with a thing; sentences that report someone's words
give none. A document is a case when the words matched in such sentences cover a large share of its own text.

The own text is the content without the lines that its source repeats (problem 2). Words that tell nothing (articles,
pronouns and the like, numbers, addresses and the site's name) count neither as matched nor as text. Markup counts where
it stands unfilled, not where a text quotes it. A null title or content counts as empty; rows of a null doc_id are kept
with their flags.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast
from .lines import LineKeys, Sets, over_own_lines, own_lines
from .quality import COMMON_WORDS

#: Share of the own text's words (by letters) that matched wording must cover.
MIN_COVERAGE = 0.5
#: The same for a title.
MIN_TITLE_COVERAGE = 0.8

# Vocabulary of error pages, notices and filler, lower case; by kind and role, one language a line
# (English, German, French, Spanish, Italian, Portuguese, Dutch, Polish, Swedish, Russian). A comma parts phrases.
VOCABULARY = {
    ("error", "thing"): """
page, pages, site, website, web page, url, link, address, server, servers, host, gateway, proxy, request, requests, requested, connection, network, database, file, files, document, resource, content, article, story, account, access, service, permission, session, front page, home page, homepage, search box, engineers, administrator, webmaster, status, status code, region, country, legal reasons, seconds, minutes, template, cloud, traffic
seite, webseite, website, adresse, server, verbindung, datenbank, datei, anfrage, dienst, zugriff, artikel, inhalt, startseite, sitzung, konto, anforderung
page, site, serveur, adresse, lien, connexion, base de données, fichier, requête, service, accès, article, contenu, accueil, compte, ressource
página, sitio, servidor, dirección, enlace, conexión, base de datos, archivo, solicitud, servicio, acceso, artículo, contenido, inicio, cuenta, recurso
pagina, sito, server, indirizzo, collegamento, connessione, file, richiesta, servizio, accesso, articolo, contenuto, home, risorsa
página, site, servidor, endereço, ligação, conexão, ficheiro, arquivo, pedido, serviço, acesso, artigo, conteúdo, início, conta
pagina, website, server, adres, koppeling, verbinding, bestand, verzoek, dienst, toegang, artikel, inhoud, startpagina, account
strona, strony, stronę, witryna, serwer, serwera, adres, połączenie, plik, żądanie, usługa, dostęp, artykuł, treść, główna
sidan, sida, webbplatsen, servern, adressen, länken, anslutning, filen, begäran, tjänsten, åtkomst, artikeln, innehållet, startsidan
страница, страницы, страницу, сайт, сервер, сервера, адрес, ссылка, соединение, файл, запрос, доступ, служба, статья
""",
    ("error", "state"): """
not found, could not be found, cannot be found, can't be found, couldn't be found, can't find, cannot find, couldn't find, no longer exists, does not exist, doesn't exist, no longer available, not available, isn't available, unavailable, forbidden, denied, refused, restricted, blocked, suspended, timeout, timed out, time-out, bad request, method not allowed, not allowed, not permitted, error, errors, fault, failed, failure, exception, expired, withdrawn, moved, removed, deleted, renamed, gone, missing, gone missing, never existed, broken, invalid, unexpected, unexpected error, overloaded, went wrong, unable, could not be shown, could not be loaded, can't be displayed, cannot be displayed, down for, maintenance, scheduled maintenance, planned work, undergoing, upgrading, being upgraded, be back, back soon, back shortly, rate limit, too many, internal, limit exceeded, undefined, null, mistyped, misspelled, outdated, internal server error, bad gateway, temporarily, received, answered
nicht gefunden, existiert nicht, nicht verfügbar, nicht erreichbar, verweigert, fehler, interner, abgelaufen, verschoben, gelöscht, entfernt, gesperrt, ungültig, wartungsarbeiten, wartung, vorübergehend, zeitüberschreitung, angeforderte, angefordert, fehlgeschlagen, leider
introuvable, n'existe plus, n'existe pas, pas trouvée, indisponible, refusé, interdit, erreur, interne, expiré, déplacée, supprimée, maintenance, momentanément, temporairement, demandée, délai, échoué, désolé
no encontrada, no encontrado, no existe, no se ha encontrado, no se encuentra, no disponible, denegado, prohibido, error, interno, caducado, movida, eliminada, mantenimiento, temporalmente, solicitada, tiempo de espera, falló, lo sentimos
non trovata, non trovato, non esiste, non è stata trovata, non disponibile, negato, vietato, errore, interno, scaduto, spostata, rimossa, eliminata, manutenzione, temporaneamente, richiesta, richiesto, scaduta, siamo spiacenti, spiacenti
não encontrada, não encontrado, não existe, não foi encontrada, indisponível, negado, proibido, erro, interno, expirado, movida, removida, eliminada, manutenção, temporariamente, solicitada, falhou, desculpe
niet gevonden, bestaat niet, niet beschikbaar, geweigerd, verboden, fout, interne, verlopen, verplaatst, verwijderd, onderhoud, tijdelijk, opgevraagde, mislukt, helaas
nie znaleziono, nie istnieje, nie została znaleziona, niedostępna, niedostępny, odmowa, zabroniony, błąd, wewnętrzny, wygasła, przeniesiona, usunięta, konserwacja, prace, tymczasowo, żądana, przepraszamy
hittades inte, finns inte, kunde inte hittas, ej tillgänglig, inte tillgänglig, nekad, förbjuden, fel, internt, flyttad, borttagen, underhåll, tillfälligt, begärda, tyvärr
не найдена, не найден, не существует, недоступна, недоступен, запрещён, запрещен, ошибка, внутренняя, удалена, перемещена, обслуживание, временно, запрошенная, извините
""",
    ("error", "request"): """
please, try, try again, retry, again, later, reload, refresh, go back, head back, return, return to, check, check the address, check the spelling, contact, contact us, quote, visit, search, searching, searching for, use the search, slow down, wait, come back, start over, sorry, oops, whoops, hmm, apologies, apologise, apologize, inconvenience, patience, thank you for your patience, expected return, working on it, looked everywhere, looking for, followed, you may have followed, told, continue, support
bitte, versuchen, erneut, später, prüfen, überprüfen, zurück, aktualisieren, laden, kontaktieren, suchen, entschuldigung, geduld
veuillez, réessayer, réessayez, plus tard, vérifier, vérifiez, retour, recharger, contacter, recherche, patience, excusez
por favor, inténtelo, intente, inténtalo, de nuevo, más tarde, compruebe, verifique, volver, vuelva, recargar, contacte, buscar, disculpe, paciencia
per favore, riprova, riprovare, più tardi, controlla, verifica, torna, tornare, ricarica, contatta, cerca, ci scusiamo, pazienza
tente, novamente, mais tarde, verifique, voltar, volte, recarregar, contacte, pesquisar, pedimos desculpa, paciência
probeer, opnieuw, later, controleer, terug, vernieuw, neem contact, zoek, excuses, geduld
proszę, spróbuj, ponownie, później, sprawdź, wróć, odśwież, skontaktuj, szukaj, cierpliwość
försök, igen, senare, kontrollera, tillbaka, ladda om, kontakta, sök, ursäkta, tålamod
пожалуйста, попробуйте, снова, позже, проверьте, вернитесь, обновите, свяжитесь, поиск, терпение
""",
    ("error", "telling"): """
page not found, 404 error, access denied, internal server error, bad gateway, gateway timeout, gateway time-out, service unavailable, too many requests, something went wrong, error establishing, could not be satisfied, problem loading page, traceback, most recent call last, stack trace, core dumped, segmentation fault, fatal error, uncaught exception, syntax error, unhandled exception, null pointer, will be back soon, thank you for your patience, http error, cannot read property, dbpool, moved or never existed, isn't here, aren't here
seite nicht gefunden, zugriff verweigert, interner serverfehler
page introuvable, accès refusé, erreur interne du serveur
página no encontrada, acceso denegado, error interno del servidor
pagina non trovata, accesso negato, errore interno del server
página não encontrada, acesso negado, erro interno do servidor
pagina niet gevonden, toegang geweigerd
nie znaleziono strony, strona nie istnieje, odmowa dostępu
sidan hittades inte, åtkomst nekad
страница не найдена, доступ запрещён
""",
    ("error", "code"): """
line, module, function, argument, property, undefined, object, attribute, block, key, body, index, type, value, render, main, exec, call, host, timeout, reference, incident, trace, request id, ray id, id, debug, caused by, ms
""",
    ("notice", "thing"): """
javascript, scripts, script, scripting, noscript, cookies, cookie, browser, browsers, page, site, website, robot, robots, bot, bots, human, captcha, ad blocker, ad blockers, adblock, ad blocking, advertising blocker, tracking, device, settings, features, app, security check, step, step below, box below, checkbox, story, content, comments, articles, network
browser, cookies, seite, werbeblocker, adblocker, roboter, einstellungen, webseite
navigateur, cookies, page, bloqueur, publicité, robot, paramètres, site
navegador, cookies, página, bloqueador, anuncios, robot, configuración, sitio
browser, cookie, pagina, blocco, pubblicità, robot, impostazioni, sito
navegador, cookies, página, bloqueador, anúncios, robô, definições, site
browser, cookies, pagina, adblocker, robot, instellingen, website
przeglądarka, przeglądarce, przeglądarki, ciasteczka, pliki cookie, strona, strony, stronę, robotem, blokada reklam, ustawieniach, witryna, skryptów, skrypty
webbläsare, webbläsaren, kakor, sidan, annonsblockerare, robot, inställningar
браузер, браузере, браузера, страница, страницы, сайт, робот, роботом, настройках, файлы
""",
    ("notice", "state"): """
disabled, turned off, switched off, not enabled, is off, not supported, does not support, doesn't support, unsupported, required, requires, needs, needed, not work, does not work, will not work, cannot keep, signed in, unusual traffic, outdated, old version, stopping, blocking, loading, stay safe, keep safe
deaktiviert, ausgeschaltet, erforderlich, benötigt, nicht unterstützt, unterstützt nicht, veraltet
désactivé, désactivés, requis, nécessaire, nécessite, n'est pas pris en charge, obsolète
desactivado, deshabilitado, necesario, requiere, no es compatible, desactivadas
disabilitato, disattivato, necessario, richiede, non supporta, richiesto
desativado, necessário, requer, não suporta
uitgeschakeld, vereist, nodig, ondersteunt niet
wyłączona, wyłączony, wyłączone, wymagany, wymaga, wymagana, nie obsługuje, potrzebny
inaktiverat, avstängt, krävs, behövs, stöds inte
отключён, отключен, отключены, требуется, необходим, не поддерживает
""",
    ("notice", "request"): """
enable, activate, allow, accept, turn on, turn it off, turn off, switch on, switch it on, whitelist, disable, pause, verify, verify you are, confirm, prove, complete, finishing, finish, solve, tick, click, press, check, checking, checking that, upgrade, update, refresh, reload, continue, proceed, before, please, view, see, read, load, moment, just a moment, one more step, are you, you are human, i'm not a, must allow, properly, uses this to
aktivieren, erlauben, zulassen, akzeptieren, bestätigen, schalten, deaktivieren, laden, bitte, fortzufahren, fortfahren, anzeigen
activer, activez, autoriser, autorisez, accepter, confirmez, désactivez, veuillez, continuer, afficher, pour
activar, active, activa, habilite, habilitar, habilita, permitir, permita, aceptar, confirme, desactive, por favor, continuar
attiva, attivare, abilita, abilitare, consenti, accetta, conferma, disattiva, per favore, continuare
ative, ativar, habilite, permita, aceite, confirme, desative, por favor, continuar
schakel, inschakelen, activeer, sta toe, accepteer, bevestig, gelieve, doorgaan
włącz, włączyć, aktywuj, zezwól, zaakceptuj, potwierdź, wyłącz, proszę, kontynuować, obsługę, działać, wyświetlić
aktivera, tillåt, godkänn, bekräfta, stäng av, fortsätta, vänligen
включите, включить, разрешите, примите, подтвердите, отключите, пожалуйста, продолжить
""",
    ("notice", "telling"): """
enable javascript, javascript is disabled, enable cookies, verify you are human, verify that you are human, i'm not a robot, are you a robot, not a robot, are you human, unusual traffic, just a moment, one more step, checking your browser, checking that you are not a robot, allow scripts, turn on javascript, noscript, needs scripts, ad blocker is stopping
""",
    ("filler", "thing"): """
text, copy, paragraph, paragraphs, headline, title, lead, lede, standfirst, subhead, caption, byline, story, quote, pull quote, article, body, content, sentence, section, slug, summary, teaser, image, photo, picture, line, box, field, layout, page, page breaks, column, readers, characters, words, editor, template, draft
text, absatz, überschrift, titel, zeile, artikel
texte, paragraphe, titre, ligne
texto, párrafo, título, línea
testo, paragrafo, titolo, riga
texto, parágrafo, título, linha
tekst, alinea, kop, regel
tekst, akapit, tytuł, wiersz, nagłówek
text, stycke, rubrik, rad
текст, абзац, заголовок, строка
""",
    ("filler", "state"): """
placeholder, dummy, sample, specimen, blank, test, filler, example, mock, untitled, goes here, to be written, to be added, to be confirmed, to be replaced, tbc, tbd, coming soon, here comes, max, maximum, only, short, layout, breaks, not for publication, replace me
platzhalter, blindtext, typoblindtext, beispieltext, muster, mustertext
remplissage, faux, factice, exemple
relleno, ejemplo, prueba, ficticio
segnaposto, esempio, prova, riempimento
exemplo, preenchimento, teste
voorbeeld, opvultekst, plaatshouder
przykładowy, zastępczy, wypełniacz, wstaw
exempel, platshållare, utfyllnad
пример, заполнитель, замените
""",
    ("filler", "request"): """
replace, replace this, replace with, your own, insert, type, type your, enter, write, write your, add, add a, delete, delete this, edit, put, paste, fill in, remove this, before going live, before publishing, before publication, going live, in this box, in this field, for checking, checking, see how, tells readers, tell readers, what happened, happened, here
ersetzen, einfügen, eingeben, löschen, schreiben, hier, ihren, hier steht
remplacer, remplacez, insérer, insérez, saisir, votre, ici
reemplace, inserte, escriba, su, aquí, borre
sostituisci, inserisci, scrivi, qui, il tuo
substitua, insira, escreva, aqui, seu
vervang, voeg, typ, hier, uw
wstaw, wpisz, zastąp, tutaj, usuń, swój
ersätt, skriv, här, din
введите, вставьте, здесь, удалите, ваш
""",
    ("filler", "telling"): """
lorem ipsum, goes here, placeholder text, dummy text, sample text, dummy copy, sample headline, test article, untitled draft, untitled, with your own, your text here, here comes the placeholder, blindtext, typoblindtext, texte de remplissage, faux texte, texto de relleno, texto de ejemplo, testo segnaposto, texto de exemplo, voorbeeldtekst, przykładowy tekst, platshållartext
""",
}
# Verbs and prepositions by which reports name who said what.
REPORTING = frozenset(
    """said says told announced reported reports explained added argued claimed according
    sagte erklärte teilte berichtete laut dit déclaré expliqué selon dijo explicó anunció según detto spiegato annunciato secondo
    disse explicou anunciou segundo zei vertelde meldde volgens powiedział powiedziała poinformował według sade enligt сказал сказала сообщил""".split()
)
# Words of the customary Latin filler that other languages hardly use, and those that stand between them.
LATIN_TELLING = frozenset(
    """adipiscing adipisicing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt dolore duis eiusmod enim excepteur exercitation fugiat
    incididunt ipsum irure laboris laborum lorem magna minim mollit nisi nostrud nulla occaecat officia pariatur proident quis reprehenderit tempor ullamco velit veniam voluptate""".split()
)
LATIN_FILLER = LATIN_TELLING | frozenset("ad do dolor ea elit esse est et eu ex id in labore non qui sed sint sit sunt ut".split())
# Runs of neighbouring keys and try-out words; the latter tell only beside the former or said over and over.
KEYBOARD_TELLING = frozenset("asd asdf asdfasdf asdfgh dfg fgh fghj ghj hjkl jkl qwe qwer qwerty qwertyuiop sdf sdfg sdfgh uiop xcv xcvb yxcv zxc zxcv zxcvb zxcvbn".split())
KEYBOARD_FILLER = KEYBOARD_TELLING | frozenset("test testing tests blah bla foo bar baz qwert wer wert".split())

#: Names that a placeholder may carry; a name in capitals or with an underscore or dot is a placeholder by its form.
_NAME = r"[A-Za-z][\w.\-]*(?:\s[\w.\-]+){0,3}"
# Forms of placeholder markup, each with an opener that the automaton looks for.
MARKUP = {
    "{{": re.compile(rf"\{{\{{\{{?\s*[#/&>^]?{_NAME}\s*\}}?\}}\}}"),
    "${": re.compile(rf"\$\{{\s*{_NAME}\s*\}}"),
    "#{": re.compile(rf"#\{{\s*{_NAME}\s*\}}"),
    "<%": re.compile(rf"<%[=\-]?\s*{_NAME}\s*-?%>"),
    "{%": re.compile(rf"\{{%-?\s*{_NAME}\s*-?%\}}"),
    "{!": re.compile(rf"\{{!\s*{_NAME}\s*!?\}}"),
    "%%": re.compile(r"%%\s*[A-Za-z]\w*\s*%%"),
    "%(": re.compile(r"%\([A-Za-z]\w*\)[sdfr]"),
    "@": re.compile(r"(?<![\w@.])@[A-Z][A-Z_]{2,}@(?!\w)"),
    "__": re.compile(r"(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)"),
    "[[": re.compile(r"\[\[\s*[A-Za-z][\w.]*(?:\s[\w.]+)?\s*\]\]"),
    "*|": re.compile(r"\*\|\s*[A-Za-z][\w:.]*\s*\|\*"),
    "[insert ": re.compile(r"(?i)\[insert [^\]\n]{1,60}\]"),
    " goes here]": re.compile(r"(?i)\[[^\]\n]{1,60} goes here\]"),
    "[object object]": re.compile(r"\[object Object\]"),
    "[your ": re.compile(r"(?i)\[your [^\]\n]{1,60}\]"),
    "&lt;": re.compile(r"&lt;\s*[a-z][a-z_\-.]*\s*/\s*&gt;"),
    "<": re.compile(r"<[A-Z]{3,}(?:_[A-Z]+)*>"),
    "{": re.compile(r"(?<![\w{])\{\d{1,2}\}(?![\w}])"),
    " tbc xxxx": re.compile(r"(?i)\(\w+ TBC X{3,}\)"),
    " to come": re.compile(r"\bTK(?:\s+TK)?\s+[\w. \-]{2,40}?\s+to come\b"),
    "headline goes here": re.compile(r"(?i)^\s*headline goes here\s*$", re.MULTILINE),
}
_SENTENCE = re.compile(r".+?(?:[.!?…]+[)\]”\"']*(?=\s|$)|$)")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Numbers with what belongs to them, paths, hosts and addresses: neither wording nor text.
_NEUTRAL = re.compile(r"\d|\w[/\\]|[/\\]\w|\S@\S|\w\.\w")
#: What parts words, for the rough cut: ASCII characters that are no letters, and the frequent wide ones.
_MARKS = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
_WIDE_MARKS = "“”„«»‘’…–—\xa0"
_CODE = re.compile(r"(?<![\d.,])[45]\d\d(?![\d,]|\.\d)")
_EXCEPTION = re.compile(r"\b\w*(?:Error|Exception)\b:?")
# Lines of program traces.
_FRAME = re.compile(r'^\s*(?:File "[^"\n]+", line \d+|at [\w.$<>]+\s?\([^)\n]*\)|at \S+:\d+:\d+)')
_QUOTES = {"'": "'", '"': '"', "“": "”", "‘": "’", "„": "“", "«": "»", "`": "`"}


def _phrases() -> dict[str, set[tuple[str, str]]]:
    out: dict[str, set[tuple[str, str]]] = {}
    for meaning, text in VOCABULARY.items():
        for phrase in text.replace("\n", ",").split(","):
            if phrase.strip():
                out.setdefault(phrase.strip(), set()).add(meaning)
    return out


PHRASES = _phrases()
#: Every word of the vocabulary and of the Latin and keyboard filler; no text with too few of them can be a case.
_VOCABULARY_WORDS = (frozenset(w for p in PHRASES for w in _TOKEN.findall(p)) - COMMON_WORDS) | LATIN_FILLER | KEYBOARD_FILLER


_VOCABULARY_BYTES = frozenset(part.encode() for w in _VOCABULARY_WORDS for part in re.split("['’]", w)) - frozenset(w.encode() for w in COMMON_WORDS)
_COMMON_BYTES = frozenset(w.encode() for w in COMMON_WORDS)


def markup_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for opener in MARKUP:
        found.add_word(opener, opener)
    found.make_automaton()
    return found


def wording_automaton() -> ahocorasick.Automaton:
    """The vocabulary, each phrase with its length and its kinds and roles."""
    found = ahocorasick.Automaton()
    for phrase, meanings in PHRASES.items():
        found.add_word(phrase, (len(phrase), meanings))
    found.make_automaton()
    return found


def has_markup(text: str, openers: set[str]) -> bool:
    """Markup that stands unfilled; none that is put in quotation marks."""
    for opener in openers:
        for match in MARKUP[opener].finditer(text):
            before, after = text[match.start() - 1 : match.start()] if match.start() else "", text[match.end() : match.end() + 1]
            if not (before in _QUOTES and _QUOTES[before] == after):
                return True
    return False


def _without_neutral(text: str) -> str:
    return " ".join([t for t in text.split() if not _NEUTRAL.search(t)])


def _word_length(words: list[str]) -> int:
    return sum(len(w) for w in words if w not in COMMON_WORDS)


def _filler_words(words: list[str]) -> bool:
    """Latin or keyboard filler, or one or two words said over and over."""
    if len(words) >= 8 and len(set(words)) <= 2:
        return True
    if any(w in LATIN_TELLING for w in words) and sum(w in LATIN_FILLER for w in words) >= 0.8 * len(words) and (len(words) >= 4 or "ipsum" in words):
        return True
    tried = sum(w in KEYBOARD_FILLER for w in words)
    return tried >= 0.7 * len(words) and (any(w in KEYBOARD_TELLING for w in words) or (len(words) >= 4 and len(set(words)) <= 2))


def judged_sentence(sentence: str, site: str, hits: ahocorasick.Automaton) -> tuple[int, dict[str, int], set[str]]:
    """(letters of its words, letters of them that each kind's wording covers, the kinds that the sentence gives evidence for)."""
    if _FRAME.match(sentence):
        n = max(1, _word_length([w.lower() for w in _TOKEN.findall(sentence)]))
        return n, {"error": n}, {"error"}
    code = _CODE.search(sentence) is not None
    exception = _EXCEPTION.match(sentence.strip()) is not None
    if exception:
        sentence = _EXCEPTION.sub(" ", sentence)
    text = sentence.lower().replace("’", "'")
    named = bool(site) and site in text
    if site:
        text = text.replace(site, " ").replace(site.replace(" ", ""), " ")
    text = f" {_without_neutral(text)} "
    words = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    total = sum(len(w) for _, w in words if w not in COMMON_WORDS)
    if _filler_words([w for _, w in words]):
        n = max(1, sum(len(w) for _, w in words))
        return n, {"filler": n}, {"filler"}
    if not total:
        return (0, {"error": 0}, {"error"}) if exception else (0, {}, set())
    if any(w in REPORTING for _, w in words if not (w == "told" and "engineers" in text)):
        return total, {}, set()
    roles: dict[str, set[str]] = {}
    spans: dict[str, bytearray] = {}
    for end, (length, meanings) in hits.iter(text):
        start = end - length + 1
        # whole words only; the text begins and ends with a space
        if text[start - 1].isalnum() or text[end + 1].isalnum():
            continue
        for kind, role in meanings:
            roles.setdefault(kind, set()).add(role)
            spans.setdefault(kind, bytearray(len(text)))[start : end + 1] = b"\1" * length
    covered = {kind: sum(len(w) for at, w in words if w not in COMMON_WORDS and marks[at]) for kind, marks in spans.items()}
    evidence = {"error"} if exception else set()
    for kind, mine in roles.items():
        thing = "thing" in mine or (kind == "error" and (code or named or exception)) or (kind == "notice" and named)
        state = "state" in mine or (kind == "error" and code and "thing" in mine)
        if "telling" in mine or (thing and (state or "request" in mine)) or (kind == "error" and "state" in mine and code):
            evidence.add(kind)
        elif not (mine & {"state", "request", "thing"} or exception):
            covered[kind] = 0
    return total, covered, evidence


def coverage(text: str, site_name: str | None, hits: ahocorasick.Automaton) -> tuple[float, str]:
    """The covered share of the words (by letters) of a text, and the kind that covers most.

    The wording of a sentence without evidence of its own counts where it covers most of the sentence, and others give evidence.
    """
    site = (site_name or "").lower()
    total = 0
    sure: dict[str, int] = {}
    beside: dict[str, int] = {}
    for line in text.split("\n"):
        for sentence in _SENTENCE.findall(line):
            n, covered, evidence = judged_sentence(sentence, site, hits)
            total += n
            if not covered:
                continue
            kind = max(sorted(evidence or covered), key=lambda k: covered.get(k, 0))
            if evidence:
                covered.setdefault(kind, 0)
                sure[kind] = sure.get(kind, 0) + covered[kind]
            elif covered[kind] >= 0.6 * n:
                beside[kind] = beside.get(kind, 0) + covered[kind]
    if not sure:
        return 0.0, ""
    matched = sum(sure.values()) + sum(beside.values())
    return (matched / total if total else 1.0), max(sure, key=sure.get)


def _share_of(words: list, vocabulary: frozenset, common: frozenset) -> tuple[int, int, bool]:
    """(letters of vocabulary words, letters of words that tell something, whether few words are said over and over)."""
    letters = sum(map(len, words))
    known = sum(map(len, filter(vocabulary.__contains__, words)))
    neutral = sum(map(len, filter(common.__contains__, words)))
    return known, letters - neutral, len(words) >= 8 and sum(map(len, set(words))) <= 0.65 * letters


def may_be_case(text: str, min_coverage: float) -> bool:
    """False where the words of the vocabulary, all counted, can't reach the coverage.

    First with words cut out roughly, in bytes, and the words of addresses and names as text: a text would need four fifths
    of these to be wrongly left out. The few that pass are counted without addresses, and with less than the coverage for
    the site's names.
    """
    text = text.lower()
    rough = text
    for mark in _WIDE_MARKS:
        rough = rough.replace(mark, " ")
    known, telling, over = _share_of(rough.encode("utf-8", "replace").translate(_MARKS).split(), _VOCABULARY_BYTES, _COMMON_BYTES)
    if known < 0.2 * min_coverage * telling and not over:
        return False
    known, telling, over = _share_of(_TOKEN.findall(_without_neutral(text.replace("’", "'"))), _VOCABULARY_WORDS, COMMON_WORDS)
    return known >= 0.6 * min_coverage * telling or over


def judge(title: str | None, own: str | None, content: str | None, site_name: str | None, markup: ahocorasick.Automaton, hits: ahocorasick.Automaton, min_coverage: float = MIN_COVERAGE) -> tuple[str, float]:
    """(kind, coverage) of a document with the ``own`` lines of its content; kind is ``''`` where it is no case."""
    title, content = title or "", content or ""
    openers = {opener for text in (title.lower(), content.lower()) for _, opener in markup.iter(text)}
    if openers and (has_markup(title, openers) or has_markup(content, openers)):
        return "residue", 1.0
    if title.strip() and may_be_case(title, MIN_TITLE_COVERAGE):
        share, kind = coverage(title, site_name, hits)
        if kind == "filler" and share >= MIN_TITLE_COVERAGE:
            return "residue", share
    if not own or not own.strip() or not may_be_case(own, min_coverage):
        return "", 0.0
    share, kind = coverage(own, site_name, hits)
    return (kind, share) if share >= min_coverage else ("", share)


def residue_flags(articles: DataFrame, sites: DataFrame, repeated: DataFrame, min_coverage: float = MIN_COVERAGE, keep: tuple[str, ...] = (), own: bool = False, derived: tuple[str, Callable[[], Callable[..., list[pa.Array]]]] | None = None) -> DataFrame:
    """(doc_id, kind, coverage) of every article; kind is ``''`` where the article is no case.

    ``sites`` (source, site_name) is a small fixed table; ``repeated`` are the lines that its source repeats (problem 2).
    Columns named in ``keep`` are handed on, and with ``own`` the content without repeated lines, empty for null.
    ``derived`` are columns made of these, so that the text needn't be handed on: their schema, and what gives a task the
    function that makes them of the contents and the kept columns.
    """
    names = sites.groupBy("source").agg(F.min("site_name").alias("site_name"))
    rows = articles.select("doc_id", "title", "content", "source", *keep).join(bounded_broadcast(names), "source", "left").select("doc_id", "title", "content", "source", "site_name", *keep)
    kinds = dict(rows.dtypes)
    schema = "doc_id long, kind string, coverage double" + "".join(f", {c} {kinds[c]}" for c in keep) + ", own string" * own + (f", {derived[0]}" if derived else "")
    out = ["doc_id", "kind", "coverage", *keep, *["own"] * own, *([x.split()[0] for x in derived[0].split(", ")] if derived else [])]

    def mapper(sets: Sets):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            markup, hits, keys = markup_automaton(), wording_automaton(), LineKeys()
            derive = derived[1]() if derived else None
            for batch in batches:
                judged, texts = [], []
                for title, content, source, name in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    text = "\n".join(own_lines(content, source, keys, sets))
                    judged.append(judge(title, text, content, name, markup, hits, min_coverage))
                    texts.append(text)
                columns = [batch.column(0), pa.array([k for k, _ in judged], pa.string()), pa.array([c for _, c in judged], pa.float64()), *(batch.column(5 + i) for i in range(len(keep)))]
                columns += [pa.array(texts, pa.string())] if own else []
                columns += derive(texts, *(batch.column(5 + i) for i in range(len(keep)))) if derive else []
                yield pa.RecordBatch.from_arrays(columns, names=out)

        return run

    return over_own_lines(rows, repeated, mapper, schema)
