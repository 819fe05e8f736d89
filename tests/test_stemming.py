"""Stems of the sample words that are published with the rules."""

from __future__ import annotations

import pytest
from tessera.functions import stemming as st

# Words and their stems. A line gives a stem and the words that have it.
SAMPLES = {
    "en": """consign: consign consigned consigning consignment|consist: consist consisted consistency consistent consistently consisting consists|consol: consolation consolations consoling consolingly console consoled
        consolatori: consolatory|consolid: consolidate consolidated consolidating|conspicu: conspicuous conspicuously|conspiraci: conspiracy|conspir: conspirator conspirators conspire conspired conspiring|constabl: constable constables
        knack: knack knacks|knackeri: knackeries|knave: knave knaves|knead: kneaded kneading|knee: knee knees|knight: knight knightly knights|knit: knit knits knitted knitting|knive: knives|knocker: knocker knockers
        tie: ties|cri: cries|gas: gas|gap: gaps|hop: hopping|hope: hoped hoping|sky: sky skies|general: general generally|communiti: community|dy: dy|die: dies|happi: happy happiness|bore: boring""",
    "de": """aufeinand: aufeinander|aufeinanderfolg: aufeinanderfolge aufeinanderfolgen aufeinanderfolgend aufeinanderfolgende aufeinanderfolgenden aufeinanderfolgender|aufenthalt: aufenthalt aufenthalten aufenthaltes|aufersteh: auferstehen auferstehung
        auferstund: auferstünde|auffall: auffallen auffallend auffallenden auffällig auffälligen auffälliges|kategori: kategorie kategorien|kategor: kategorisch|kat: kater katers|katz: katze katzen|katzch: kätzchen|kauf: kauf kaufe kaufen käufer
        kauflich: käuflich|kausalitat: kausalität|keck: keck kecker keckste|keinesfall: keinesfalls|strass: straße""",
    "nl": """licham: lichaam lichamelijk lichamelijke lichamelijkheden lichamen|licht: licht lichte lichten|lichter: lichters|lichtst: lichtste|opging: opgingen|opglanz: opglanzing opglanzingen|opglimp: opglimpen opglimpende opglimping opglimpingen
        opgroei: opgroeien opgroeiende|ophal: ophaal ophalen ophalend|opheff: opheffen opheffing|ophelder: opheldering|opheusd: opheusden""",
    "fr": """continu: continu continua continuait continuant continuation continue continué|main: main mains|mainten: maintenaient maintenait maintenant maintenir|maintenu: maintenue|maintien: maintien|mair: maire maires mairie|mais: mais|maï: maïs
        maison: maison maisons|maîtr: maître|majest: majesté|majestu: majestueuse majestueusement majestueux|majeur: majeur majeure""",
    "es": """chec: checa checar checo|chel: chelo|chequ: cheque cheques|cheque: chequeo|cheyen: cheyene|chi: chía|chiap: chiapas|chic: chica chicas chico|chican: chicana chicano|chicharron: chicharrones|tor: torá toreado toreados toreándolo torear toreara torearlo toro toros
        torax: tórax|torc: torcer|tore: toreó|torer: torero toreros|torment: tormenta tormentas|torn: tornado tornados tornar tornen torno|torne: torneo torneos|toront: toronto|torped: torpedearon|torpez: torpeza|torrencial: torrenciales|torrent: torrente""",
    "pt": """boa: boa|boas: boas|boat: boataria boate boates boatos|bob: boba bobear bobo|bobag: bobagem|bobalhõ: bobalhões|boc: boca bocadas bocado bocas|bocaiúv: bocaiúva|bodoqu: bodoque|bogot: bogotá|boi: boi boiando|quil: quilo quilos|quilométr: quilométricas quilométricos
        químic: química químicas químico|quinhã: quinhão|quinhent: quinhentos|quintal: quintal|quintessent: quintessência|quintuplic: quintuplicou|quinz: quinze|quiosqu: quiosque""",
    "it": """abbandon: abbandona abbandonata abbandonate abbandonati abbandonato abbandonava abbandonerà abbandoneranno abbandonerò abbandonò|abbass: abbassamento abbassando abbassandola abbassare abbassarono abbassarsi abbassassero abbassò|abbast: abbastanza
        abbatt: abbatté abbattendo abbattere abbattersi abbatteva abbattimento|abbaz: abbazia abbazie|pront: pronto|pronunc: pronuncerà pronuncia pronunciamento pronunciare pronunciarsi|propag: propaga propagare propagarsi propagazione|propagand: propaganda
        prop: propende propio|propens: propensi|propension: propensione|propon: propone proponendo proponendosi|proponent: proponenti""",
    "ru": """вагон: вагон вагона вагоне вагонов вагоном вагоны|важн: важная важнее важнейшие важнейшими важно важного важный важных|важнича: важничал|ваз: вазах вазы|валанда: валандался|валерианов: валериановых|валер: валерию|валет: валетами|вал: вал вали валил валился валится валов
        валя: валяется валялась валялись валялось валялся валять валяются|пада: падает падай падал падала падать падаю падают падающего падающие|падал: падаль|паден: падение падением падении падений паденье|падуч: падучая""",
    "sv": """jakt: jakt jakten|jaktböss: jaktbössa|jaktkarl: jaktkarl jaktkarlar jaktkarlarne jaktkarlens|jaktlöjtnant: jaktlöjtnant jaktlöjtnanten jaktlöjtnantens|jam: jama jamande jamade|klock: klocka|klockan: klockan klockans|klok: klok kloka klokare klokast klokaste klokhet klokheten|klokt: klokt""",
    "no": """havnedistrikt: havnedistrikt havnedistriktene havnedistrikter havnedistriktet havnedistriktets|havneforbund: havneforbund havneforbundets|havneforvaltning: havneforvaltningen|havnefunksjon: havnefunksjonene|opning: opning opninga
        opparbeid: opparbeide opparbeidede opparbeider opparbeides opparbeidet opparbeidelse""",
    "da": """indtag: indtage indtagelse indtager indtages indtaget|indtræd: indtræde indtræder|indtræf: indtræffe indtræffer|indtræng: indtrængende|undersøg: undersøge undersøgelse undersøgelsen undersøgt|undertryk: undertrykke undertrykkelse|undervis: undervise|undersåt: undersåtter""",
}


def pairs(text):
    for line in text.replace("\n", "|").split("|"):
        stem, _, words = line.strip().partition(": ")
        for word in words.split():
            yield word, stem


@pytest.mark.parametrize("code", sorted(SAMPLES))
def test_sample_words(code):
    wrong = {w: (st.STEMMERS[code](w), stem) for w, stem in pairs(SAMPLES[code]) if st.STEMMERS[code](w) != stem}
    assert wrong == {}


@pytest.mark.parametrize("code", sorted(st.STEMMERS))
def test_any_word_has_a_stem(code):
    """No word is lost, whatever it is made of; a stem is not longer than two letters more."""
    import random

    rng = random.Random(code)
    for _ in range(3000):
        word = "".join(rng.choices("abdegilmnorstuyéèêïöæиваеть'_-q", k=rng.randint(0, 14)))
        stem = st.STEMMERS[code](word)
        assert (stem or not word.strip("'")) and len(stem) <= len(word) + 2 or word in ("'s", "'s'")


def test_stems_are_kept_and_forgotten(monkeypatch):
    monkeypatch.setattr(st, "KEPT", 10)
    stems = st.Stems()
    for n in range(50):
        assert stems.of("en", f"word{n}s") == f"word{n}s".removesuffix("s")
        assert len(stems.known) <= 10
    assert stems.of("xx", "words") == "words" and stems.of(None, "words") == "words"
