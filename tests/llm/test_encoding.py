from __future__ import annotations

import random

import pytest

from evidra.llm.encoding import repair, repair_texts, unescape

CLEAN = [
    None, "", "plain ascii, with 50% & more; see a=b", "Thanks – that’s naïve but fine.", "Our Zürich office says “no”.", "Â is a valid letter in Româna fields, so is Ț.", "Þórðavík and Æðruhólmur are depots.",
    "Ângela wrote “NÃO”, and that is correct.", "√x ≤ 3 ∂y", "├── src └── out", "日本語の項目名", "שם השדה", "한글 조합", "🦊🚀 👩‍🔬 🇨🇭 1️⃣", "µ-service: 5 µs ± 1 µs, ½", "ＦＵＬＬ", "𝔘𝔫𝔦 𝟙𝟚𝟛", "donʼt ʻokina", "Příliš žluťoučký kůň úpěl ďábelské ódy",
    "Цена выросла, а поддержка отвечает только через несколько дней.", "Ґанок і її файли", "Açıkçası şirket için küçük çözüm", "Évry-l'Âge", "© ® ™ € £ ¥ § ° ª º ¿ ¡ « »", "é and é", "EXPORTAÇÃO", "non breaking thin", "Årsmøte på øya", "https://a.example/x?y=%20z",
]
SENTENCES = [
    "Die Übergabe läuft über ein größeres Skript, das ist überraschend schön.", "Le prix a augmenté de 40 € sans préavis – c’est gênant, déjà très pénible.", "¿Alguien sabe cómo pasar los años anteriores? La migración está incluida.",
    "Já fez a migração sem perder informações? Não funcionou à primeira.", "Wdrożyliśmy to w 6 dni, a zespół szybko się przyzwyczaił, jakość wzrosła.", "Kısa soru: fiyat arttı ama şirket için çözüm yeterli görünüyor, satırı kaybediyor.", "Документация устарела, поэтому пришлось спрашивать у соседней команды.",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_stays(text):
    assert repair(text) == (False, text, "")


def wrong(text, charset):
    raw = text.encode("utf-8")
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-15"])
def test_utf8_read_otherwise_comes_back(charset):
    exact = 0
    for text in SENTENCES:
        bad = wrong(text, charset)
        garbled, fixed, _ = repair(bad)
        assert garbled
        exact += fixed == text
    assert exact >= 6


def test_twice_and_in_a_stretch():
    text = SENTENCES[1]
    assert repair(wrong(wrong(text, "cp1252"), "cp1252"))[1] == text
    part = "The café says “hi”. " + wrong("naïve", "cp1252") + " – and so on – " + "Grün."
    assert repair(part)[:2] == (True, "The café says “hi”. naïve – and so on – Grün.")
    assert repair("It costs " + wrong("€12", "cp1252"))[:2] == (True, "It costs €12")
    assert repair(wrong("£9", "latin-1"))[:2] == (True, "£9")


@pytest.mark.parametrize(("text", "meant", "shown"), [(SENTENCES[4], "iso8859-2", "latin-1"), (SENTENCES[4], "cp1250", "cp1252"), (SENTENCES[5], "cp1254", "cp1252"), (SENTENCES[6], "koi8-r", "cp1251"), (SENTENCES[6], "cp1251", "cp1252"), (SENTENCES[6], "cp866", "cp1251"), (SENTENCES[6], "cp1251", "koi8-r")])
def test_single_byte_mix_ups(text, meant, shown):
    bad = "".join(_one(b, shown) for b in text.encode(meant, "ignore"))
    garbled, fixed, _ = repair(bad)
    original = text.encode(meant, "ignore").decode(meant)
    assert garbled and sum(a == b for a, b in zip(fixed.split(), original.split())) >= 0.8 * len(original.split())


def _one(b, charset):
    try:
        return bytes([b]).decode(charset)
    except UnicodeDecodeError:
        return chr(b)


def test_beyond_repair_is_found():
    for text in ("caf�", "it\x99s", "a � b"):
        assert repair(text)[0]


def test_escapes():
    assert unescape("caf&eacute; &#8217; a%C3%A9 \\u00e9 =C3=A9 &lt; &amp; %20") == "café ’ aé é é &lt; &amp; %20"


def test_very_long_and_spark(spark):
    long = ("Clean grün text. " * 8000) + wrong("größer", "cp1252")
    r = random.Random(1)
    data = [(1, None, "x"), (2, "", "x"), (3, "fine", "x"), (4, long, "x"), (5, wrong("größer", "cp1252"), "x"), (6, wrong("größer", "cp1252"), "x")]
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string, garbled string")
    got = {x["doc_id"]: x for x in repair_texts(df, "doc_id", "text").collect()}
    assert [got[i]["garbled"] for i in range(1, 7)] == [False, False, False, True, True, True]
    assert got[4]["restored"].endswith("größer") and len(got[4]["restored"]) == len(long) - 2 and got[1]["restored"] is None
    assert repair_texts(df.where("false"), "doc_id", "text").count() == 0


#: Own sentences, one or more for each language, with letters and signs that must never be touched.
LIVING = {
    "Croatian": "Molim vas, pošaljite mi račun još danas jer sutra zatvaram knjige za ovaj mjesec, čini se da je đak već otišao kući.",
    "Lithuanian": "Ąžuolas auga lėtai, tačiau jo šaknys siekia giliai į žemę, o šį rudenį jūsų užsakymai bus išsiųsti.",
    "Latvian": "Lūdzu, pārbaudiet, vai šķīvji ir tīri, jo viesi ieradīsies pēc stundas un ļoti gribēs ēst.",
    "Estonian": "Täna õhtul sõidame järve äärde, sest öösel on seal vaikne ja külm õhk värskendab.",
    "Finnish": "Älä unohda ottaa sateenvarjoa mukaan, sillä tänään iltapäivällä sää näyttää epävakaalta.",
    "Slovak": "Včera večer sme ešte dlho sedeli pri ohni a ľudia spievali staré piesne, kým vŕba šumela.",
    "Slovenian": "Če želiš, lahko jutri skupaj obiščeva stari grad na griču in pojeva kosilo v vaški gostilni.",
    "Albanian": "Ky është një shembull i thjeshtë që tregon se si përdoret gjuha jonë çdo ditë në shtëpi.",
    "Maltese": "Għandna bżonn nitkellmu dwar il-ħsarat li ġraw fil-għassa, ċempilli meta tasal il-ġurnata.",
    "Yoruba": "Ẹ káàárọ̀ o, ṣé ẹ sùn dáadáa? Mo fẹ́ ra ọ̀pẹ̀ òyìnbó ní ọjà lónìí.",
    "Serbian": "Овај воз не стаје у малим местима, па ћемо морати да пођемо раније и пређемо реку његовим чамцем.",
    "Macedonian": "Ќе ти се јавам кога ќе стигнам дома, бидејќи сега сум зафатен со ѓаконот и неговата куќа.",
    "Belarusian": "Сёння ўвечары мы пойдзем у госці да бабулі, якая спякла для нас вялікі пірог з яблыкамі.",
    "Kazakh": "Бүгін ауа райы өте жақсы, сондықтан біз қаланың сыртына шығып, өзен жағасында демаламыз.",
    "Catalan": "Demà anirem a la plaça perquè hi haurà una festa; la col·lecció de l’àvia és preciosa, això sí.",
    "Irish": "Oibríonn an siopa seo go déanach agus tá fáilte roimh gach duine, más é do thoil é.",
    "Welsh": "Mae’r tŷ ar y bryn yn hen iawn, ond mae’r ŵyn bach yn chwarae wrth ymyl y môr.",
    "Gaelic": "Tha an t-uisge ann an-diugh, ach bidh a’ ghrian a’ dèarrsadh a-màireach gu cinnteach, tha mi ’n dòchas.",
    "Basque": "Etxeko atea irekita dago, baina ez da inor ikusten; piñudiko bidea hartu dute.",
    "Galician": "A choiva non parou en toda a noite e o río xa está moi alto; mañá haberá néboa, segundo din.",
    "Icelandic": "Það er kalt úti í dag og snjórinn þekur öll fjöllin, svo við förum ekki út fyrr en síðdegis.",
    "Faroese": "Í dag er veðrið gott, og vit fara út at sigla við bátinum hjá abba, ið býr úti í Kirkjubø.",
    "Danish": "Børnene løber ude på gaden, mens bedstefar sidder på bænken og læser sin avis på årets første varme dag.",
    "Norwegian": "Jeg skal på hytta i helgen, så vi får håpe at været blir bra og at bålet tar fyr på første forsøk.",
    "Swedish": "Barnen åkte släde hela förmiddagen och drack sedan varm choklad på kaféet vid ån.",
    "Dutch": "De coördinator heeft het idee geüpload, en één van de reünisten vond het vóór alles héél mooi.",
    "Hungarian": "A szűk utcában régi házak állnak, és az öreg fűzfa árnyékában játszanak a gyerekek őszi délutánokon.",
    "Romanian": "Mâine dimineață plecăm la țară și vom sta acolo până duminică, fiindcă bunicii ne așteaptă.",
    "Turkish": "Bugün hava çok güzel, ama akşam yağmur yağacakmış; şemsiyeni yanına almayı unutma, İzmir’e gidiyoruz.",
    "Azerbaijani": "Sabah tezdən kəndə gedəcəyik, çünki nənəm bizi gözləyir və şirniyyat hazırlayıb, ağır işlər də var.",
    "Vietnamese": "Hôm nay trời đẹp quá, chúng ta hãy đi dạo quanh hồ rồi uống một cốc cà phê sữa đá nhé.",
    "Esperanto": "Ĉiuj homoj rajtas ĝui pacan vivon, kaj ŝanĝoj venas kiam ni aŭdas unu la alian kaj ĵetas timon for.",
    "Greek": "Αύριο θα πάμε στη θάλασσα, αν ο καιρός είναι καλός και δεν φυσάει πολύς αέρας στο νησί.",
    "Ukrainian": "Завтра вранці їдемо до бабусі в село, бо там уже достигли вишні й є багато роботи в ґрунті. Від Різдва минув рік.",
    "Bulgarian": "Утре сутринта ще тръгнем рано, защото пътят през планината е дълъг и стръмен.",
    "Russian": "Вчера мы долго гуляли по набережной, а потом ели мороженое и смотрели на корабли. Газета «Труд» и НАТО — «США, КТ».",
    "Tatar": "Бүген һава бик җылы, шуңа күрә балалар урамда уйныйлар һәм су буена төшәләр.",
    "Mongolian": "Өнөөдөр тэнгэр цэлмэг, бид морио унаад уул өөд гарч, үдээс хойш буцаж ирнэ.",
    "Polish": "Zażółć gęślą jaźń, mówił dziadek, gdy wieczorem siadaliśmy przy piecu i słuchaliśmy opowieści o Łodzi.",
    "Czech": "Příliš žluťoučký kůň úpěl ďábelské ódy, říkala paní učitelka a děti se smály až do oběda.",
    "Portuguese": "Não há razão para tanta pressão; amanhã às três fazemos a reunião e decidimos o próximo passo com atenção.",
    "Spanish": "¿Mañana vendrás con nosotros? Habrá música, piñatas y muchísima comida según la señora del pingüino.",
    "French": "L’été dernier, nous sommes allés à la plage où le château s’élève près des flots ; c’était déjà très agréable, cœur léger.",
    "German": "Übermorgen müssen wir früh aufstehen, weil der Zug nach Köln schon um fünf Uhr fährt – heißt das, du schläfst hier?",
    "Italian": "Perché non vieni più a trovarci? La città è così bella di sera, e il caffè lo offro io, però.",
    "Hebrew": "מחר בבוקר ניסע אל הים, אם מזג האוויר יהיה נאה והרוח לא תהיה חזקה מדי.",
    "Arabic": "سنذهب غدًا إلى السوق القديم لنشتري الخبز والفواكه، ثم نعود قبل غروب الشمس.",
    "Hindi": "कल सुबह हम नदी के किनारे घूमने जाएँगे और शाम को दादी के घर खाना खाएँगे।",
    "Thai": "พรุ่งนี้เช้าเราจะไปตลาดกับคุณยายแล้วกลับมาทำอาหารกลางวันด้วยกัน",
    "Chinese": "明天早上我们去河边散步，然后到外婆家吃午饭。",
    "Japanese": "あしたの朝、川のそばを散歩してから、おばあさんの家で昼ご飯を食べます。",
    "Korean": "내일 아침에 강가를 산책한 다음 할머니 댁에서 점심을 먹을 거예요.",
    "Georgian": "ხვალ დილით მდინარესთან ვისეირნებთ და შემდეგ ბებიასთან ვისადილებთ.",
    "Armenian": "Վաղը առավոտյան կզբոսնենք գետի ափին, հետո կճաշենք տատիկի տանը։",
    "Hausa": "Ɗan yaro ya ƙi cin abinci saboda yana jin ƙishirwa, sai ɓarawo ya zo.",
    "Igbo": "Ụmụ anyị na-aga ụlọ akwụkwọ kwa ụbọchị, ọ bụ eziokwu, ha na-amụ ihe nke ọma.",
    "Hawaiian": "ʻO kēia ka hale o koʻu kupuna kāne, a ʻaʻole mākou e haʻalele i kēia lā.",
    "Pinyin": "Wǒ míngtiān zǎoshang qù gōngyuán sànbù, nǐ yào bù yào yìqǐ lái?",
    "Kurdish": "Ez sibê diçim gund, ji ber ku dapîra min li bendê ye û şîv hazir e.",
    "Technical": "The 5µm filter at −20 °C costs €12.50 ± 5 %; see § 3.2 “Limits” — x² ≤ 4 × 10⁻³, naïve café résumé façade, Ångström, Zoë’s piñata.",
    "Names": "Þórsmörk lies near Sigurðsson’s farm, für Gäste; señor Muñoz met Dvořák, Lech Wałęsa and Nguyễn Văn A in Malmö.",
}


@pytest.mark.parametrize("language", LIVING)
def test_living_languages_stay_and_come_back(language):
    text = LIVING[language]
    for clean in (text, text.upper(), f"{text} {text[:40]}", text.split()[0]):
        assert repair(clean) == (False, clean, "")
    for charset in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"):
        assert repair(wrong(text, charset))[0]


def test_living_languages_come_back_exactly():
    pairs = [(text, repair(wrong(text, charset))[1]) for text in LIVING.values() for charset in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")]
    assert sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_any_number_of_wrong_decodings():
    text = "Die Übergabe kostet 40 € – schön."
    for _ in range(6):
        text = wrong(text, "cp1252")
    assert repair(text)[1] == "Die Übergabe kostet 40 € – schön."


def test_time_grows_with_length():
    import time

    began = time.perf_counter()
    for unit in ("é", "Ã©", "â€™", "Рё", "&eacute;", "&", "%C3", "a'", "Ш", "中"):
        repair(unit * 10_000)
    assert time.perf_counter() - began < 60
