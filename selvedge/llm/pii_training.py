"""Labelled training texts for the personal-data model, made by rule.

No labelled corpus exists, so the model learns from texts assembled here:
carrier sentences with a slot, contact blocks of several slots, and sentences
with numbers and names that are no personal data. Everything is drawn from a
seeded generator; TRAINING_TEXTS bounds the sample. The sentences are everyday
ones written for this purpose; none is taken from a table the model is run on.
"""

from __future__ import annotations

import random

TRAINING_TEXTS = 6000
SEED = 20260901

#: Given names common in French and English; the corpus adds its own.
GIVEN_NAMES = (
    "adam agathe agnès aïcha alain albert alice amélie amir anaïs andrea andrew anita anna anne antoine arthur aurèle aurélie barbara bastien beatrice benoît bernard brigitte bruno "
    "camille carla carlos caroline catherine cécile céline charles charlotte chloé christine claire clara claude clément colin damien daniel david deborah denis dennis diane dylan edith edward "
    "eleanor elena elise élodie elodie emily emma émile eric estelle ethan étienne eva fabrice fatima fatou felix fiona florence francis françois frank gabriel gaspard gemma george gérard "
    "gilles greta guillaume hannah hassan hector helen hélène héloïse henri hugh hugo ibrahim inès irène isabelle ivan ivor jack jacques james jane jeanne jennifer jérôme joanna john jonas josé "
    "joseph judith jules julie karim karen kevin laura laurent léa lena léon leila linda louis louise lucas lucie lucy marc marcel margaret marie martin martha mathilde matthew maud max mehdi "
    "michel milo mireille mohamed monique nadège nadia nathalie nicolas nina noah nora oliver omar oscar patricia patrick paul petra peter philippe pierre priya rachel rafael rania raphaël rebecca rémi "
    "richard robert rosa rufus samir samuel sandra sarah simon solène sophie stephen susan sylvie tessa théo thibault thomas timothy tom valérie victor vincent walter wanda william xavier yann yannick yasmine yves zoé"
).split()
_SYLLABLES = "ba be bo bra ca cor da del do dru fa fe fla gar go gri hal hu ja ka ke la le lin lo ma mar me mo na ne no pa pel pi qua ra re ri ro sa se si so ta te ti to tre va ve vi vo wa wil za".split()
_ENDS = "rd ck son ton lin ert eau ier on et ard ley by ford man court val ne ro di ski ens in ois ac".split()
TITLES = ["Dr", "Dr.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms.", "Miss", "Prof.", "Nurse", "Doctor", "M.", "Mme", "Mlle", "Madame", "Monsieur", "Docteur", "Professeur"]
_STREETS_EN = ["Street", "St.", "Road", "Rd", "Avenue", "Lane", "Terrace", "Drive", "Close", "Crescent"]
_STREETS_FR = ["rue", "avenue", "boulevard", "place", "quai", "impasse", "allée", "chemin"]

CARRIERS = {
    "NAME": [
        "Hello, this is {} writing.", "I'm {} and I would like advice.", "The report carries the name of {}.", "{} looked after my mother.", "On Friday {} examined my knee.", "We spoke with {} at the desk.", "Afterwards {} phoned the ward.", "I am {}, and I need help.",
        "{} thinks otherwise.", "Since then {} has been away.", "Notes taken by {}.", "As {} explained, rest is enough.", "With thanks, {}.", "Yours sincerely, {}.", "Warm regards, {}.", "Name of the patient: {}.", "Referred patient: {}.", "You may ask for {}.", "My neighbour {} had the same.",
        "Her full name is {}.", "A form signed by {} came later.", "A man called {} rang.", "She was last seen by {} in May.", "According to {}, all is well.", "I met {} today.", "Then {} came in.", "{} called again this morning.", "Ask {} about it.", "I was seen by {} last week.",
        "Bonjour, ici {}.", "Je suis {} et je voudrais un avis.", "Selon {}, tout va bien.", "C'est {} qui m'a examinée lundi.", "Compte rendu rédigé par {}.", "Nom du patient : {}.", "Patient adressé : {}.", "Bien à vous, {}.", "Très cordialement, {}.", "Ma voisine {} a eu pareil.",
        "Demandez {} à l'accueil.", "{} est passée ce matin.", "D'après {}, le repos suffit.", "On m'appelle {}.", "Un certificat signé {} est joint.", "Elle fut reçue par {} en urgence.", "Une dame nommée {} attend.", "J'ai vu {} hier.", "J'ai été reçu par {} mardi.",
    ],
    "PHONE": [
        "Ring {} in the evening.", "Telephone {} for an appointment.", "Our landline is {}.", "Fax {} for the forms.", "You'll get me on {} most days.", "Dial {} and ask for the ward.", "Cell {} or leave a note.", "My new number is {}, please note it.", "Emergency contact number {}.", "Call me on {}.",
        "Phone {} once the shop shuts.", "You can reach me at {}.", "My sister's mobile is {} for now.", "Tel. {} before noon.", "She may be reached on {} at work.", "The patient answers on {}.", "Our record lists {} for calls.", "The patient asks for a call on {}.", "Patients may call {} until six.", "Appelez le {} après le déjeuner.", "Joignez-moi au {} en journée.", "Téléphone fixe : {}.", "Tél. {} le matin.", "Le numéro de ma fille est le {}.",
        "Téléphonez au {} pour un rendez-vous.", "Ligne directe {} au bureau.", "Mobile {} de préférence.", "Téléphone : {}.", "On peut me joindre au {} après 18 h.", "Merci de rappeler le {} ce soir.", "Le patient répond au {} le soir.", "Joindre la patiente au {} avant 17 h.", "Le dossier indique le {} pour tout appel.", "Le portable de mon fils est le {}.",
    ],
    "ID_NUMBER": [
        "SSN {} is on the form.", "Her social security no. is {}.", "Her passport no. {} expired.", "Passport {} was shown.", "The insurance policy number is {}.", "Insurance card {} was copied.", "Member number {} was checked.", "My file bears the number {}.", "Hospital record {} belongs to me.", "File no. {} is attached.", "MRN {} on the bracelet.",
        "NHS number {}.", "Chart number {} was opened.", "ID card {} was copied.", "Patient identifier {} was assigned.", "Patient number {} please.", "Mon numéro de sécurité sociale est le {}.", "IPP {} noté.", "Passeport {} présenté.", "Numéro d'assuré : {}.", "Le dossier porte le numéro {}.", "Dossier n° {} à transmettre.",
        "Pièce d'identité {} vérifiée.", "Assurée sous le numéro {} depuis mai.", "NIR {} à reporter.", "Mutuelle, adhérent {}.",
    ],
    "ADDRESS": [
        "We moved to {} in June.", "Post it to {}.", "My flat is at {}.", "Home address {} since spring.", "She lives at {} with her son.", "The parcel goes to {}, thank you.", "Deliver it to {} please.", "Our house is {}, ground floor.", "Nous logeons au {} depuis mai.", "Elle demeure {} chez sa fille.", "Adresse du domicile, {}.", "Livrez le lit au {}.", "Mon appartement est au {}.",
        "Adressez le courrier au {}, merci.", "Envoyez tout au {}.", "Le kiné viendra au {} jeudi.",
    ],
    "EMAIL": ["Reach my inbox {} any time.", "Mail me at {}.", "Write to {} please.", "Send it ({}) soon.", "E-mail address {} on the form.", "Copie à {} s'il vous plaît.", "Mes messages arrivent sur {}.", "Répondez-moi sur {} merci.", "Envoyez le tout ({}) avant lundi."],
}
BLOCKS = [("({})", " ; "), ("({})", " / "), ("({})", ", "), ("({})", " - "), ("Details for you: {}.", " ; "), ("Her card says {}.", " - "), ("Voici mes informations : {}.", " / "), ("Fiche du jour : {}.", ", "), ("Registered as {}.", " / "), ("En bref, {}.", ", "), ("The record shows {}.", " ; "), ("Patient contact, {}.", " / "), ("Our file holds {}.", ", "), ("Dossier complété : {}.", " - "), ("Patient joint : {}.", " ; "), ("Dossier complet, {}.", ", "), ("Carte du patient, {}.", " / "), ("Patient record, {}.", " - "), ("For the file, {}.", " ; ")]
#: Sentences with look-alikes of personal data; {d} digits, {S} an invented surname, {T} an invented town, {G} a given name.
DECOYS = [
    "Batch {d9} left the shelves in {y}.", "Lot {d9} expired in {y}.", "Le lot numéro {d10} n'est plus vendu depuis {y}.", "Lot {d10} rappelé en {y}.", "See article {d2}.{d3}.{d4} of the catalogue.", "Article {d2}.{d3}.{d4} is new.", "Voir l'article {d2}.{d3}.{d4} du catalogue.", "Normal range {d3}-{d3}, measured {d3}.{d2}.", "Range {d3}-{d3}, reading {d3}.", "Intervalle {d3}-{d3}, mesure {d3},{d2}.",
    "Bornes {d3}-{d3}, relevé {d3}.", "Pressure was {d3}/{d2} on {y}-06-21.", "Her {S} score came to {d1}.", "Score de {S} à {d1} ce jour.", "{T} Memorial Hospital opened {d3} rooms.", "L'hôpital de {T} a {d3} lits.", "A pharmacy stands on {S} Road.", "La pharmacie de la rue {S} ouvre tôt.", "Read @{t}clinic on that.", "Voyez @{t}info pour la suite.",
    "The {S} sign was negative.", "La maladie de {S} est rare.", "{S} disease is rare.", "A dose of {d3} mg, then {d2} mg at 18:30.", "In {T} the clinic offers a scan.", "À {T}, le centre propose un bilan.", "He slept {d2} hours in {d1} nights.", "Order {d8} has shipped.", "Référence produit {d10}.",
    "Batch number {d9} is fine.", "La norme {d5}-{d2} s'applique.", "Le syndrome de {S} est exclu.", "ISBN {d3}-{d1}-{d4}-{d4}-{d1}.", "It showed {d2}.{d1} degrees at {d2}:{d2}.", "Walking {d2} minutes helps, see page {d3}.", "Rue {S}, la pharmacie est fermée.", "{T} lies {d2} km away.",
    "A nurse may teach you how to do it.", "The nurse will visit tomorrow.", "Ask your doctor or pharmacist.", "The doctor would know.", "A doctor saw me at noon.", "Our professor spoke in {T}.", "Le docteur est absent.", "Mon docteur pense que oui.", "Madame, merci de patienter.", "Un monsieur attend dehors.",
    "Nurse visits are free.", "Miss one dose and wait.", "A {d2}-year-old nurse from {T} wrote this.", "The clinic told me in {T} that it is called rest.", "Both carers around me seem fine.", "The page at clinic.example.com lists it.", "Mail.example.com was down.", "See clinic.example.org at noon.",
    "A nurse {t} you how.", "The nurse {t} again, then left.", "My doctor {t} it.", "Mon docteur {t} cela.", "The professor {t} slowly.", "{G} {t} it again.",
    "The {G} scale was used.", "Published {y}-{d2}-{d2}, volume {d3}, pages {d3}-{d3}.", "Serial {d4}-{d4}-{d4}.",
    "Le contrôle du {d2}/{d2}/{y} est normal.", "The visit of {d2}-{d2}-{y} went well.", "Pression relevée {d3}/{d2}, contrôle {d2}/{d2}/{y}.",
]


class Maker:
    """Draws values and texts with known spans."""

    def __init__(self, seed: int = SEED):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, low: int = 2, high: int = 3) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(low, high))) + self.r.choice(_ENDS)

    def surname(self) -> str:
        s = self.word().capitalize()
        return f"{s}-{self.word().capitalize()}" if self.r.random() < 0.1 else s

    def name(self) -> tuple[str, int]:
        """(text, where the name itself starts)."""
        given, surname = self.r.choice(GIVEN_NAMES).capitalize(), self.surname()
        k = self.r.random()
        if k < 0.4:
            return f"{given} {surname}", 0
        if k < 0.55:
            return f"{surname.upper()} {given}", 0
        title = self.r.choice(TITLES)
        rest = self.r.choice([surname, f"{given} {surname}", f"{self.r.choice('ABCDEFGHJKLMNPRSTVW')}. {surname}"])
        return f"{title} {rest}", len(title) + 1

    def phone(self) -> str:
        d, s = self.digits, self.r.choice(" .-")
        return self.r.choice([
            f"0{self.r.choice('123456789')}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"0{d(9)}", f"+33 {self.r.choice('1234567')} {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"1{s}{d(3)}{s}{d(3)}{s}{d(4)}",
            f"+1 {d(3)} {d(3)} {d(4)}", f"+1{d(10)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"+49 {d(3)} {d(7)}",
        ])

    def number(self) -> str:
        d, s, r = self.digits, self.r.choice(" .-"), self.r
        letters = "".join(r.choices("ABCDEFGHJKLMNPQRSTVWXYZ", k=2))
        return r.choice([f"{letters}{d(r.randint(6, 9))}", f"{letters}{d(r.randint(6, 9))}{r.choice('ABCDXYZ')}", f"{letters[0]}{d(2)}/{d(5)}", f"{d(3)}{s}{d(2)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", d(8), d(15), d(12), f"{r.choice('12')}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(3)}{s}{d(3)}{s}{d(2)}"])

    def address(self) -> str:
        n, r = str(self.r.randint(1, 240)), self.r
        town, name = self.word().capitalize(), self.word().capitalize()
        if r.random() < 0.5:
            number = n + r.choice(["", "", " bis", " ter", ","])
            street = f"{r.choice(_STREETS_FR)} {r.choice(['', 'du ', 'des ', 'de la '])}{name}"
            return f"{number} {street}" + r.choice([f", {town}", f"\n99{self.digits(3)} {town}", f", 99{self.digits(3)} {town}", f" 99{self.digits(3)} {town}"])
        street = f"{r.choice(['', '', 'Old ', 'New '])}{name} {r.choice(_STREETS_EN)}"
        flat = r.choice(["", "", f", Apt {r.randint(1, 90)}", f", Flat {r.randint(1, 9)}"])
        return f"{n}{r.choice(['', '', 'A', 'B'])} {street}{flat}" + r.choice([f", {town}", f"\n{town} 00{self.digits(3)}", f", {town} ZZ{r.randint(1, 9)} {r.randint(1, 9)}XX"])

    def email(self) -> str:
        r = self.r
        local = r.choice([f"{self.word(1, 2)}.{self.word(1, 2)}", f"{self.word()}_{r.randint(1, 99)}", f"contact.{self.word()}+rdv", f"{self.word()}{r.randint(1, 999)}", f"{self.word(1, 1)}-{self.word()}", f"{self.word(1, 1)[0]}{self.word()}"])
        at, dot = r.choice([("@", "."), ("@", "."), (" @ ", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" arobase ", " point "), ("(at)", ".")])
        return f"{local}{at}{r.choice(['mail', 'post', 'clinic-' + self.word(1, 2), self.word()])}{dot}example{dot}{r.choice(['com', 'org', 'net'])}"

    def value(self, kind: str) -> tuple[str, int]:
        """(text, where the piece itself starts); some pieces are all in one case."""
        if kind == "NAME":
            text, at = self.name()
        else:
            text, at = {"PHONE": self.phone, "ID_NUMBER": self.number, "ADDRESS": self.address, "EMAIL": self.email}[kind](), 0
        case = self.r.random()
        return (text.lower() if case < 0.12 else text.upper() if case < 0.18 and len(text.upper()) == len(text) else text), at

    def decoy(self) -> str:
        s = self.r.choice(DECOYS).replace("{S}", self.surname()).replace("{T}", self.word().capitalize()).replace("{t}", self.word()).replace("{y}", str(self.r.randint(1990, 2025))).replace("{G}", self.r.choice(GIVEN_NAMES).capitalize())
        for n in range(1, 11):
            while f"{{d{n}}}" in s:
                s = s.replace(f"{{d{n}}}", self.digits(n), 1)
        return s

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        k = self.r.random()
        if k < 0.4:
            return self.decoy(), []
        kinds = ["NAME", "PHONE", "ID_NUMBER", "ADDRESS", "EMAIL"]
        if k < 0.75:
            kind = self.r.choice(kinds)
            before, after = self.r.choice(CARRIERS[kind]).split("{}")
            text, at = self.value(kind)
            return before + text + after, [(len(before) + at, len(before) + len(text), kind)]
        frame, separator = self.r.choice(BLOCKS)
        text, spans = frame.split("{}")[0], []
        for n, kind in enumerate(self.r.sample(kinds, self.r.randint(2, 3))):
            text += separator * (n > 0)
            label = self.r.choice(["ID ", "MRN ", "patient no. ", "dossier n° ", "NIR ", "IPP "]) if kind == "ID_NUMBER" else ""
            value, at = self.value(kind)
            spans.append((len(text) + len(label) + at, len(text) + len(label) + len(value), kind))
            text += label + value
        return text + frame.split("{}")[1], spans

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []
        for _ in range(self.r.randint(1, 4)):
            s, found = self.sentence()
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += s + self.r.choice([" ", " ", "\n"])
        case = self.r.random()
        if case < 0.08 and len(text.upper()) == len(text):
            text = text.upper()
        elif case < 0.2:
            text = text.lower()
        return text, spans


def training_texts(n: int = TRAINING_TEXTS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker = Maker()
    return [maker.text() for _ in range(n)]
