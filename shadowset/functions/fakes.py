"""Made-up text as column expressions: a pure function of seed, stream and row id, evaluated in the JVM.

Word lists come with a few languages; locales of other languages in the list are accepted by the interface but raise
NotImplementedError, so that nobody gets English names without noticing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shadowset.functions import random as R

# Column names by what they hold; the first row that has the whole name or one of its segments wins.
DISPATCH = [
    (["name", "full_name", "fullname", "customer_name", "employee_name"], "name"),
    (["first_name", "firstname", "fname"], "first_name"),
    (["last_name", "lastname", "lname", "surname"], "last_name"),
    (["email", "email_address"], "email"),
    (["phone", "phone_number", "telephone", "tel"], "phone"),
    (["address", "street", "street_address"], "address"),
    (["city"], "city"),
    (["company", "company_name", "org", "organization"], "company"),
    (["url", "website", "homepage"], "url"),
    (["description", "comment", "comments", "note", "notes", "remarks", "detail", "details", "summary", "body", "text", "content", "message"], "sentence"),
]
# The accepted locales.
LOCALES = [
    "en_US", "en_GB", "en_AU", "en_CA", "en_NZ", "fr_FR", "de_DE", "de_AT", "de_CH", "es_ES", "es_MX", "it_IT", "pt_BR", "pt_PT", "nl_NL", "nl_BE", "pl_PL", "sv_SE", "da_DK", "nb_NO",
    "fi_FI", "ja_JP", "ko_KR", "zh_CN", "zh_TW", "ru_RU", "uk_UA", "cs_CZ", "ro_RO", "hu_HU", "ar_SA", "he_IL", "hi_IN", "th_TH", "vi_VN",
]

WORDS = "able above across active again agree allow along among answer appear autumn basket begin behind better between blue board bridge bright bring build carry center change circle clear cloud collect corner cover create dance deep direct double dream early earth eight enjoy even field final follow forest fresh garden gather gentle glass green happy hold island jump kind large late learn light listen little long market measure middle minute modern moment morning motion narrow nature never notice number ocean open order paper pattern people plain planet plant point quiet reach ready record river round sample season second shape shore short signal silver simple small smooth south spring square stone story street strong summer table think three tower travel under value visit water window winter wonder yellow".split()
JOBS = "Accountant,Architect,Baker,Biologist,Carpenter,Chemist,Cook,Dentist,Designer,Driver,Editor,Electrician,Engineer,Farmer,Gardener,Geologist,Journalist,Lawyer,Librarian,Mechanic,Musician,Nurse,Optician,Painter,Pharmacist,Photographer,Pilot,Plumber,Surgeon,Surveyor,Teacher,Translator".split(",")
COUNTRIES = "Argentina,Australia,Austria,Belgium,Brazil,Canada,Chile,Colombia,Denmark,Egypt,Finland,France,Germany,Ghana,Greece,India,Indonesia,Ireland,Italy,Japan,Kenya,Malaysia,Mexico,Morocco,Netherlands,Norway,Peru,Poland,Portugal,Spain,Sweden,Thailand,Turkey,Uruguay,Vietnam".split(",")
PEOPLE = {
    "en": ("Alice Amy Andrew Anna Ben Carol Daniel David Ellen Emma Frank George Grace Harry Helen Jack James Jane John Kate Laura Lucy Mark Mary Nora Oliver Paul Peter Rachel Robert Ruth Sam Sarah Simon Susan Thomas Tom Victor Walter William", "Adams Allen Baker Bell Brown Carter Clark Cole Cooper Davis Evans Fisher Foster Gray Green Hall Harris Hill Hughes Jones King Lewis Martin Miller Moore Morgan Parker Reed Scott Shaw Smith Stone Taylor Turner Walker Ward Watson White Wood Young", "Ashford Brookfield Clayton Dunmore Eastwick Fairview Glenwood Harborough Kingsley Lakeside Marlow Northfield Oakham Redhill Springdale Westbury", "Street Road Avenue Lane", "Ltd Inc Group PLC"),
    "de": ("Anja Bernd Claudia Dieter Elke Frank Gisela Hans Heike Ingrid Jens Jutta Karin Klaus Lars Monika Nina Petra Ralf Sabine Sven Tanja Ulrich Uwe Werner Wolfgang", "Bauer Becker Braun Fischer Hoffmann Huber Klein Koch Lange Maier Meyer Neumann Richter Schmidt Schneider Schulz Schwarz Wagner Weber Wolf Zimmermann", "Altdorf Bergheim Eichstadt Grünau Hohenfels Lindental Neuburg Rosenheim Steinbach Waldkirch", "Straße Weg Allee Gasse", "GmbH AG KG"),
    "fr": ("Alain Anne Antoine Camille Catherine Claire Denis Élise François Gérard Hélène Henri Isabelle Jacques Jean Julie Louis Luc Marie Michel Nathalie Nicole Paul Pierre Sophie Thérèse", "Bernard Blanc Bonnet Chevalier David Dubois Dupont Durand Fontaine Fournier Garnier Girard Lambert Laurent Lefebvre Leroy Martin Mercier Moreau Petit Robert Rousseau Roux Simon Vincent", "Beaumont Belleville Clairval Fontenay Grandpré Montclair Rivière Saint-Clair Valmont Vernay", "rue avenue boulevard chemin", "SA SARL SAS"),
    "es": ("Alberto Ana Antonio Beatriz Carlos Carmen Cristina Diego Elena Fernando Inés Javier Jorge José Juan Laura Lucía Luis Manuel María Marta Miguel Pablo Pedro Pilar Rosa Sofía Teresa", "Alonso Álvarez Blanco Castro Díaz Fernández García Gil Gómez González Hernández Jiménez López Martín Martínez Moreno Muñoz Navarro Ortega Pérez Ramírez Ramos Ruiz Sánchez Serrano Torres", "Alameda Buenavista Casablanca Fuentealta Montealegre Riosol Santa-Clara Valverde Villanueva", "calle avenida plaza paseo", "SA SL"),
    "it": ("Alessandro Andrea Anna Antonio Carla Chiara Davide Elena Federica Francesco Giulia Giuseppe Laura Lorenzo Luca Marco Maria Matteo Paola Paolo Roberto Sara Silvia Stefano", "Barbieri Bianchi Bruno Colombo Conti Costa Esposito Ferrari Fontana Galli Greco Lombardi Mancini Marino Moretti Ricci Rinaldi Romano Rossi Russo", "Acquaviva Borgonuovo Castelfiore Collalto Fontanabella Montesereno Pontevecchio Roccaverde Vallechiara Villafranca", "via viale piazza corso", "SpA Srl"),
    "pt": ("Ana André António Beatriz Bruno Carlos Catarina Daniel Eduardo Fernanda Gabriel Helena Inês João José Luís Mariana Marta Miguel Paula Pedro Rafael Rita Sofia Tiago", "Almeida Alves Carvalho Costa Dias Fernandes Ferreira Gomes Lopes Marques Martins Oliveira Pereira Pinto Ribeiro Rocha Rodrigues Santos Silva Sousa", "Aldeia-Nova Campo-Verde Boavista Fonte-Clara Monte-Alegre Pedra-Branca Ribeira-Alta Rio-Claro Serra-Azul Vila-Flor", "rua avenida praça travessa", "Lda SA"),
    "nl": ("Anke Bram Daan Eva Femke Hanna Hendrik Jan Jeroen Johan Joke Karin Koen Lotte Maaike Maarten Marijke Pieter Ruben Sanne Sander Thijs Tom Wim", "Bakker Bos Brouwer Dekker Dijkstra Hendriks Jacobs Jansen Kok Kuiper Meijer Mulder Peeters Postma Prins Smit Visser Vos Willems Wouters", "Beekdorp Groenveld Heuvelrode Kerkwijk Molenbeek Nieuwland Oosterhout Rietveld Waterdam Zandvoorde", "straat laan weg plein", "BV NV"),
    "sv": ("Anders Anna Astrid Björn Elin Emma Erik Eva Gustav Ingrid Johan Karin Lars Lena Linnea Magnus Maja Mats Nils Olle Oskar Per Sara Sven", "Andersson Berg Bergström Carlsson Eriksson Forsberg Gustafsson Hansson Holm Jansson Johansson Karlsson Larsson Lind Lindberg Nilsson Nyström Olsson Persson Svensson", "Björkvik Ekby Fagerås Granholm Lindsund Norrtorp Sjöhamn Skogsby Stenkulla Västerlund", "gatan vägen gränd torget", "AB HB"),
}
DIGITS = 10


def language(locale: str | None) -> str:
    locale = locale or "en_US"
    if locale not in LOCALES:
        raise ValueError(f"unknown locale {locale}")
    if locale[:2] not in PEOPLE:
        raise NotImplementedError(f"no word lists for {locale}")
    return locale[:2]


class Fakes:
    """Providers for one seed and locale: name -> (row id, stream) -> string column."""

    def __init__(self, seed: int = 0, locale: str | None = None):
        self.seed = seed
        self.first, self.last, self.town, self.road, self.firm = (x.split() for x in PEOPLE[language(locale)])

    def _pick(self, row: Column, stream: str, values: list) -> Column:
        return R.choice(row, self.seed, stream, values)

    def _digits(self, row: Column, stream: str, n: int) -> Column:
        return F.lpad(R.integer(row, self.seed, stream, DIGITS**n).cast("string"), n, "0")

    def first_name(self, row, stream):
        return self._pick(row, stream + "/first", self.first)

    def last_name(self, row, stream):
        return self._pick(row, stream + "/last", self.last)

    def name(self, row, stream):
        return F.concat_ws(" ", self.first_name(row, stream), self.last_name(row, stream))

    def email(self, row, stream):
        return F.concat(F.lower(self.first_name(row, stream)), F.lit("."), F.lower(self.last_name(row, stream)), self._digits(row, stream + "/d", 3), F.lit("@example."), self._pick(row, stream + "/tld", ["com", "net", "org"]))

    def phone(self, row, stream):
        return F.concat(F.lit("+"), self._digits(row, stream + "/c", 2), F.lit(" "), self._digits(row, stream + "/a", 3), F.lit(" "), self._digits(row, stream + "/b", 6))

    def city(self, row, stream):
        return self._pick(row, stream + "/town", self.town)

    def zipcode(self, row, stream):
        return self._digits(row, stream + "/zip", 5)

    def address(self, row, stream):
        return F.concat_ws(" ", (R.integer(row, self.seed, stream + "/no", 999) + 1).cast("string"), self.last_name(row, stream), F.concat(self._pick(row, stream + "/road", self.road), F.lit(",")), self.zipcode(row, stream), self.city(row, stream))

    def company(self, row, stream):
        return F.concat_ws(" ", self.last_name(row, stream), self._pick(row, stream + "/firm", self.firm))

    def url(self, row, stream):
        return F.concat(F.lit("https://www."), self._pick(row, stream + "/w", WORDS), F.lit("-"), self._pick(row, stream + "/x", WORDS), F.lit(".example.com/"))

    def words(self, row, stream, n: int) -> Column:
        text = F.concat_ws(" ", *(self._pick(row, f"{stream}/{i}", WORDS) for i in range(n)))
        return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000), F.lit("."))

    def sentence(self, row, stream):
        return self.words(row, stream, 10)

    def short_sentence(self, row, stream):
        return self.words(row, stream, 6)

    def paragraph(self, row, stream):
        return F.concat_ws(" ", *(self.words(row, f"{stream}/{i}", 8) for i in range(4)))

    def uuid(self, row, stream):
        return R.uuid(row, self.seed, stream)

    def date(self, row, stream):
        return F.date_add(F.lit("1970-01-01").cast("date"), R.integer(row, self.seed, stream, 20_000).cast("int")).cast("string")

    def country(self, row, stream):
        return self._pick(row, stream, COUNTRIES)

    def job(self, row, stream):
        return self._pick(row, stream, JOBS)


PROVIDERS = ("name", "first_name", "last_name", "email", "phone", "address", "city", "company", "url", "sentence", "paragraph", "uuid", "date", "country", "job", "zipcode")
OPTIONS = ["auto", *sorted(PROVIDERS)]


def provider_for(column: str, override: str | None = None, strict: bool = False) -> str:
    """The provider of a column: a valid override, else by name. strict: whole names are looked up before segments, so that first_name gets first names."""
    if override in PROVIDERS:
        return override
    low = column.lower()
    segments = set(low.replace(" ", "_").split("_"))
    if strict:
        for names, provider in DISPATCH:
            if low in names:
                return provider
    return next((provider for names, provider in DISPATCH if low in names or not segments.isdisjoint(names)), "short_sentence")


def fake_column(fakes: Fakes, column: str, override: str | None = None, strict: bool = False) -> Callable[[Column, str], Column]:
    return getattr(fakes, provider_for(column, override, strict))
