"""Template residue: markup, filler, error pages and notices, and reports that only mention them."""

import pytest

from loomsearch.llm import residue

MARKUP, WORDING = residue.markup_automaton(), residue.wording_automaton()
NEWS = "The council of Norham voted for the new bridge on Monday.\nResidents welcomed the plan, which had been delayed for years.\nWork is to begin in spring."


def kind(content, title="Bridge approved in Norham", site="Harrow Post"):
    return residue.judge(title, content, content, site, MARKUP, WORDING)[0]


@pytest.mark.parametrize(
    "text",
    [
        "{{ article.title }}", "${headline}", "<%= title %>", "%%IMAGE_ALT%%", "@FIRST_NAME@", "[INSERT COMPANY NAME HERE]", "[object Object]", "*|COMPANY_NAME|*", "[standfirst goes here]", "{!user.name!}", "#{title}", "%(name)s", "__BODY__", "[[ headline ]]", "<HEADLINE>", "{0}",
    ],
)
def test_markup(text):
    assert kind(NEWS + f"\nAccording to {text} the vote was close.") == "residue"
    assert kind(NEWS, title=f"{text} in Norham") == "residue"


@pytest.mark.parametrize("text", ["the mayor [of Norham] said", "a 5 < 7 goal", "“{{first_name}}”", "`${user}`", "[sic]", "[Mr Hall] agreed", "profit of {about} 5 m", "a@b.example", "set {1, 2}"])
def test_no_markup(text):
    assert kind(NEWS + f"\nThe e-mail read {text} and was sent twice.") == ""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Hmm, this page seems to have gone missing. Try searching or head back to the home page.", "error"),
        ("404\nThe link you followed is broken or the page has been removed.", "error"),
        ("502 Bad Gateway\nnginx", "error"),
        ("Spiacenti, la pagina richiesta non è stata trovata sul server. Torna alla home.", "error"),
        ("Die Seite wurde leider nicht gefunden. Bitte prüfen Sie die Adresse.", "error"),
        ("Désolé, la page demandée est introuvable. Veuillez vérifier l'adresse.", "error"),
        ("Lo sentimos, la página solicitada no existe. Inténtelo de nuevo más tarde.", "error"),
        ("Przepraszamy, strona nie została znaleziona. Sprawdź adres.", "error"),
        ("De opgevraagde pagina bestaat niet. Controleer het adres.", "error"),
        ("Извините, страница не найдена. Проверьте адрес.", "error"),
        ("Traceback (most recent call last):\n  File \"/srv/app/render.py\", line 20, in render\nKeyError: 'body'", "error"),
        ("Aby wyświetlić stronę, włącz JavaScript w przeglądarce.", "notice"),
        ("JavaScript must be enabled in your browser to read this page.", "notice"),
        ("Pour afficher cette page, veuillez activer JavaScript dans votre navigateur.", "notice"),
        ("Para continuar, habilite JavaScript y las cookies en su navegador.", "notice"),
        ("Per continuare abilita JavaScript e i cookie nel browser.", "notice"),
        ("Please confirm you are not a robot by completing the captcha.", "notice"),
        ("We use cookies. Your browser has cookies turned off; enable cookies in the settings.", "notice"),
        ("Insert your summary text in this field. Delete this sample paragraph before publication.", "filler"),
        ("Placeholder for the caption. Editor: replace with your own text.", "filler"),
        ("Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.", "filler"),
        ("asdf qwer asdf jkl zxcv asdf sdfg", "filler"),
        ("Word word word word word word word word word.", "filler"),
    ],
)
def test_pages_without_news(text, found):
    assert kind(text) == found


@pytest.mark.parametrize(
    "text",
    [
        "Network Rail is upgrading 40 stations in the north before the end of the year.",
        "Fishing in the bay will be forbidden from next month to protect young cod.",
        "Customers saw error 404 when they opened the bank's page, and the bank said that something went wrong.",
        "An internal server error kept 400 farmers from their grants, the ministry said.",
        "The app of the Council showed access denied to 200 networks on Monday.",
        "A banner printed with lorem ipsum hung over the strike in Dorvinpel until Sunday.",
        "The form asked people to enable JavaScript before they could apply, Arlen Orfencor said.",
        "\n".join(["“You came back,” she whispered.", "“I had to.”", "“Nobody asked you.”", "He looked at the door.", "The access denied sign hung there.", "“Open it.”", "“Later.”", "Rain fell.", "They waited.", "Dawn broke."]),
        "\n".join([f"Norham {i}-{i + 1} Elton" for i in range(12)] + ["Match was scheduled maintenance day"]),
        "The story was missing a page, and readers wrote to the editor about it for weeks.",
        "404 people were evacuated from the hotel in Norham.",
        NEWS,
        "",
    ],
)
def test_reports(text):
    assert kind(text) == ""


@pytest.mark.parametrize(("title", "found"), [("Headline goes here", True), ("Untitled draft", True), ("Test article 19", True), ("Lorem ipsum dolor sit amet", True), ("Page not found: library loses its oldest book", False), ("Test match ends in a draw", False)])
def test_titles(title, found):
    assert (kind(NEWS, title=title) == "residue") == found


def test_flags(spark):
    rows = [(1, None, None, None, "x"), (2, "T", "", "a", "x"), (None, "T", "404 Not Found", "a", "x"), (3, "T", "Got a tip for Harrow Post? Call us.\nPage not found.", "a", "x"), (4, "{{title}}", None, "b", "x")]
    articles = spark.createDataFrame(rows, "doc_id long, title string, content string, source string, site_name string")
    sites = spark.createDataFrame([("a", "Harrow Post"), ("a", "Harrow Post"), (None, "x")], "source string, site_name string")
    from loomsearch.llm.lines import LineKeys

    repeated = spark.createDataFrame([("a", LineKeys()("Got a tip for Harrow Post? Call us."))], "source string, key long")
    assert {r.doc_id: r.kind for r in residue.residue_flags(articles, sites, repeated).collect()} == {1: "", 2: "", None: "error", 3: "error", 4: "residue"}
    assert residue.residue_flags(articles.limit(0), sites, repeated).count() == 0
    assert residue.residue_flags(articles, sites, repeated.limit(0)).where("doc_id = 3").first().coverage > 0
