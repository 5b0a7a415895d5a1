"""Ordinary prose of languages and scripts beyond those of the test tables is kept."""

import pytest

from loomline.llm import quality

PROSE = {
    "hi": "भारत के कई गाँवों में सुबह बहुत जल्दी शुरू हो जाती है। लोग सूरज निकलने से पहले उठ जाते हैं और अपने पशुओं को चारा देते हैं। बच्चे स्कूल जाने की तैयारी करते हैं और माताएँ रसोई में गरम रोटियाँ बनाती हैं। दोपहर को किसान पेड़ की छाया में बैठकर थोड़ा आराम करते हैं। शाम को सब लोग चौपाल पर मिलते हैं, समाचार सुनते हैं और पुराने दिनों की बातें करते हैं। रात को आकाश में तारे साफ दिखाई देते हैं क्योंकि वहाँ शहर जैसी रोशनी नहीं होती।",
    "ko": "한국의 가을은 맑은 하늘과 시원한 바람으로 유명하다. 사람들은 주말마다 산에 올라가 단풍을 구경하고 사진을 찍는다. 시장에는 새로 수확한 사과와 배가 가득하고 상인들은 큰 소리로 손님을 부른다. 아이들은 학교 운동장에서 달리기를 하며 부모들은 나무 그늘에 앉아 이야기를 나눈다. 저녁이 되면 가족이 모여 따뜻한 국을 먹고 하루 동안 있었던 일을 서로 들려준다. 할머니는 오래된 노래를 부르고 손자는 옆에서 조용히 듣다가 잠이 든다. 창밖에는 달이 밝게 떠 있고 마을은 점점 조용해진다. 내일도 좋은 날씨가 이어질 것이라고 라디오에서 말했다.",
    "th": "ประเทศ ไทย มี อาหาร หลาย ชนิด ที่ มี ชื่อเสียง ไป ทั่ว โลก คน ไทย ชอบ กิน ข้าว กับ แกง และ ผัก สด ทุก วัน ตอน เช้า ตลาด จะ เต็ม ไป ด้วย ผู้คน ที่ มา ซื้อ ปลา ผลไม้ และ ดอกไม้ เด็ก ๆ เดิน ไป โรงเรียน กับ เพื่อน ส่วน ผู้ใหญ่ ไป ทำงาน ใน เมือง ตอน เย็น ครอบครัว กลับ มา กิน ข้าว ด้วย กัน และ เล่า เรื่อง ที่ เกิด ขึ้น ใน วัน นั้น ให้ กัน ฟัง ก่อน เข้า นอน พวก เขา ดู ดาว บน ท้องฟ้า ด้วย กัน",
    "bn": "বাংলাদেশের গ্রামগুলোতে সকাল হয় পাখির ডাকে। কৃষকেরা ভোরে মাঠে যায় এবং ধান কাটে। নদীর ধারে জেলেরা জাল ফেলে মাছ ধরে আর ছেলেমেয়েরা সাঁতার কাটে। দুপুরে সবাই একসঙ্গে বসে ভাত খায় এবং একটু বিশ্রাম নেয়। বিকেলে বাজারে অনেক লোক আসে, তারা সবজি, মাছ আর কাপড় কেনে। সন্ধ্যায় ঘরে ঘরে আলো জ্বলে এবং দাদি নাতিদের পুরোনো দিনের গল্প শোনান। রাতে আকাশে চাঁদ ওঠে আর চারদিক শান্ত হয়ে যায়। পরের দিন আবার নতুন করে কাজ শুরু হয়।",
    "ta": "தமிழ்நாட்டின் கிராமங்களில் காலை நேரம் மிகவும் அழகாக இருக்கும். விவசாயிகள் அதிகாலையில் எழுந்து வயலுக்குச் செல்கிறார்கள். பெண்கள் வீட்டு வாசலில் கோலம் போடுகிறார்கள், குழந்தைகள் பள்ளிக்குத் தயாராகிறார்கள். மதிய வேளையில் எல்லோரும் ஒன்றாக அமர்ந்து சோறும் குழம்பும் சாப்பிடுகிறார்கள். மாலையில் கோயில் மணி ஒலிக்கும், மக்கள் அங்கே கூடி பாடல்களைக் கேட்பார்கள். இரவில் பாட்டி பேரக்குழந்தைகளுக்குப் பழைய கதைகளைச் சொல்வாள். வானத்தில் நட்சத்திரங்கள் ஒளிரும், ஊர் முழுவதும் அமைதியாக உறங்கும். அடுத்த நாள் காலை மீண்டும் புதிய வேலைகள் தொடங்கும் என்று அனைவரும் அறிவார்கள். மழைக்காலத்தில் ஆறுகள் நிரம்பி வயல்கள் பசுமையாக மாறும்.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin, sukupuoleen, kieleen, uskontoon, poliittiseen tai muuhun mielipiteeseen, kansalliseen tai yhteiskunnalliseen alkuperään, omaisuuteen, syntyperään tai muuhun tekijään perustuvaa erotusta. Jokaisella yksilöllä on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Herkes, ırk, renk, cinsiyet, dil, din, siyasi veya diğer herhangi bir akide, milli veya içtimai menşe, servet, doğuş veya herhangi diğer bir fark gözetilmeksizin işbu beyannamede ilan olunan bütün haklardan ve bütün hürriyetlerden istifade edebilir. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. Hiç kimse kölelik veya kulluk altında bulundurulamaz.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Mọi người đều được hưởng tất cả những quyền và tự do nêu trong bản tuyên ngôn này, không phân biệt chủng tộc, màu da, giới tính, ngôn ngữ, tôn giáo, chính kiến hay quan điểm khác.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Mindenki, bármely megkülönböztetésre, nevezetesen fajra, színre, nemre, nyelvre, vallásra, politikai vagy bármely más véleményre, nemzeti vagy társadalmi eredetre, vagyonra, születésre vagy bármely más körülményre való tekintet nélkül hivatkozhat a jelen nyilatkozatban kinyilvánított összes jogokra és szabadságokra. Minden személynek joga van az élethez, a szabadsághoz és a személyi biztonsághoz.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, narodowości, pochodzenia społecznego, majątku, urodzenia lub jakiegokolwiek innego stanu. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחירויות שנקבעו בהכרזה זו ללא הפליה כלשהי מטעמי גזע, צבע, מין, לשון, דת, דעה פוליטית או דעה בבעיות אחרות, בגלל מוצא לאומי או חברתי, קניין, לידה או מעמד אחר. כל אדם יש לו הזכות לחיים, לחירות ולביטחון אישי. לא יהיה אדם עבד או משועבד.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που προκηρύσσει η παρούσα διακήρυξη, χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες, τις πολιτικές ή οποιεσδήποτε άλλες πεποιθήσεις, την εθνική ή κοινωνική καταγωγή.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي أو الثروة أو الميلاد أو أي وضع آخر، دون أية تفرقة بين الرجال والنساء.",
}


@pytest.fixture(scope="module")
def measure():
    return quality._measure(None)


@pytest.mark.parametrize("tagged", [True, False])
@pytest.mark.parametrize("lang", sorted(PROSE))
def test_ordinary_prose_is_kept(measure, lang, tagged):
    assert measure(PROSE[lang], lang if tagged else None)[6]


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_noise_in_the_same_script_is_not(measure, lang):
    words = PROSE[lang].split()
    assert not measure(" ".join(words[:6] * 12), lang)[6]


@pytest.mark.parametrize("lang, script", [("hi", "indic"), ("bn", "indic"), ("ta", "indic"), ("ko", "cjk"), ("th", "other"), ("he", "hebrew"), ("ar", "arabic"), ("el", "greek"), ("vi", "vietnamese"), ("pl", "latin")])
def test_scripts(lang, script):
    assert quality.script_of(PROSE[lang]) == script


def test_scripts_do_not_overlap():
    import re

    chars = {name: re.compile(f"[{spec}]") for name, spec in quality.SCRIPTS.items()}
    assert all(sum(bool(c.match(chr(i))) for c in chars.values()) <= 1 for i in range(0x10000) if not 0xD800 <= i < 0xE000)
