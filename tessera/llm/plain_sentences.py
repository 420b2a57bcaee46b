"""Plain sentences of everyday life, by language: they widen the models of the languages beyond the
texts of a corpus, set the limits of rejection, and give the models of languages to be rejected.
"""

# Sentences of the ten languages that are told apart.
KNOWN = {
    "en": """The children walked home from school because the bus was late again.
She bought some bread, a little cheese and two bottles of water at the market.
My brother has lived near the sea since he was twelve years old.
If it rains tomorrow, we will stay inside and watch an old film together.
Nobody knew why the lights in the kitchen had gone out so early.
He asked whether there was enough time to visit the museum before lunch.
The doctor told them that they should drink more water and sleep longer.
All human beings are born free and equal in dignity and rights.
What would you like to eat this evening, fish or chicken with rice?
They have been working in the garden since the early morning.
The train to the north leaves at eight and arrives shortly before noon.
I cannot remember where I put the keys that you gave me yesterday.
Thousands of people came to the city to listen to the music of the band.
Our neighbours are very kind, although their dog barks through the night.
Please write your name here and send the letter back as soon as possible.
It was the most beautiful house which we had ever seen in our lives.
Farmers in the valley grow apples, wheat and a great variety of vegetables.
The new phone is cheaper than the one I wanted to buy last year.
Where did you learn to play the guitar so well?
Everyone has the right to rest and leisure, including holidays with pay.""",
    "de": """Die Kinder gingen zu Fuß nach Hause, weil der Bus wieder zu spät kam.
Sie kaufte auf dem Markt etwas Brot, ein wenig Käse und zwei Flaschen Wasser.
Mein Bruder wohnt am Meer, seit er zwölf Jahre alt ist.
Wenn es morgen regnet, bleiben wir zu Hause und sehen uns einen alten Film an.
Niemand wusste, warum das Licht in der Küche so früh ausgegangen war.
Er fragte, ob vor dem Mittagessen noch Zeit für einen Besuch im Museum sei.
Der Arzt sagte ihnen, dass sie mehr Wasser trinken und länger schlafen sollten.
Alle Menschen sind frei und gleich an Würde und Rechten geboren.
Was möchtest du heute Abend essen, Fisch oder Huhn mit Reis?
Seit dem frühen Morgen arbeiten sie im Garten.
Der Zug nach Norden fährt um acht ab und kommt kurz vor Mittag an.
Ich kann mich nicht erinnern, wohin ich die Schlüssel gelegt habe.
Tausende kamen in die Stadt, um die Musik der Gruppe zu hören.
Unsere Nachbarn sind sehr freundlich, obwohl ihr Hund die ganze Nacht bellt.
Bitte schreiben Sie hier Ihren Namen und schicken Sie den Brief bald zurück.
Es war das schönste Haus, das wir je in unserem Leben gesehen hatten.
Die Bauern im Tal bauen Äpfel, Weizen und viele Sorten Gemüse an.
Das neue Telefon ist billiger als das, welches ich voriges Jahr kaufen wollte.
Wo hast du so gut Gitarre spielen gelernt?
Jeder hat das Recht auf Erholung und Freizeit und auf bezahlten Urlaub.""",
    "fr": """Les enfants sont rentrés à pied de l’école parce que le bus était encore en retard.
Elle a acheté du pain, un peu de fromage et deux bouteilles d’eau au marché.
Mon frère habite près de la mer depuis qu’il a douze ans.
S’il pleut demain, nous resterons à la maison pour regarder un vieux film.
Personne ne savait pourquoi la lumière de la cuisine s’était éteinte si tôt.
Il a demandé s’il restait assez de temps pour visiter le musée avant le déjeuner.
Le médecin leur a dit qu’ils devaient boire plus d’eau et dormir davantage.
Tous les êtres humains naissent libres et égaux en dignité et en droits.
Que veux-tu manger ce soir, du poisson ou du poulet avec du riz ?
Ils travaillent dans le jardin depuis tôt ce matin.
Le train du nord part à huit heures et arrive peu avant midi.
Je ne me souviens plus où j’ai mis les clés que tu m’as données hier.
Des milliers de gens sont venus en ville pour écouter la musique du groupe.
Nos voisins sont très gentils, bien que leur chien aboie toute la nuit.
Veuillez écrire votre nom ici et renvoyer la lettre dès que possible.
C’était la plus belle maison que nous ayons jamais vue de notre vie.
Les paysans de la vallée cultivent des pommes, du blé et beaucoup de légumes.
Le nouveau téléphone est moins cher que celui que je voulais acheter.
Où as-tu appris à si bien jouer de la guitare ?
Toute personne a droit au repos et aux loisirs, et à des congés payés.""",
    "es": """Los niños volvieron a pie de la escuela porque el autobús llegó tarde otra vez.
Ella compró pan, un poco de queso y dos botellas de agua en el mercado.
Mi hermano vive cerca del mar desde que tenía doce años.
Si mañana llueve, nos quedaremos en casa y veremos una película antigua.
Nadie sabía por qué la luz de la cocina se había apagado tan temprano.
Preguntó si había bastante tiempo para visitar el museo antes de comer.
El médico les dijo que debían beber más agua y dormir más horas.
Todos los seres humanos nacen libres e iguales en dignidad y derechos.
¿Qué quieres cenar esta noche, pescado o pollo con arroz?
Están trabajando en el jardín desde muy temprano por la mañana.
El tren del norte sale a las ocho y llega poco antes del mediodía.
No recuerdo dónde puse las llaves que me diste ayer.
Miles de personas vinieron a la ciudad para escuchar la música del grupo.
Nuestros vecinos son muy amables, aunque su perro ladra toda la noche.
Escriba aquí su nombre, por favor, y devuelva la carta lo antes posible.
Era la casa más hermosa que habíamos visto en nuestra vida.
Los campesinos del valle cultivan manzanas, trigo y muchas verduras.
El teléfono nuevo es más barato que el que yo quería comprar el año pasado.
¿Dónde aprendiste a tocar tan bien la guitarra?
Toda persona tiene derecho al descanso y a vacaciones pagadas.""",
    "pt": """As crianças voltaram a pé da escola porque o ônibus chegou atrasado outra vez.
Ela comprou pão, um pouco de queijo e duas garrafas de água no mercado.
O meu irmão mora perto do mar desde que tinha doze anos.
Se chover amanhã, ficaremos em casa e veremos um filme antigo.
Ninguém sabia por que a luz da cozinha se tinha apagado tão cedo.
Ele perguntou se havia tempo suficiente para visitar o museu antes do almoço.
O médico disse-lhes que deviam beber mais água e dormir mais horas.
Todos os seres humanos nascem livres e iguais em dignidade e em direitos.
O que você quer comer hoje à noite, peixe ou frango com arroz?
Eles estão trabalhando no jardim desde a manhã cedo.
O trem do norte sai às oito e chega pouco antes do meio-dia.
Não me lembro onde pus as chaves que você me deu ontem.
Milhares de pessoas vieram à cidade para ouvir a música do grupo.
Os nossos vizinhos são muito gentis, embora o cão deles ladre toda a noite.
Por favor, escreva aqui o seu nome e devolva a carta assim que possível.
Era a casa mais bonita que já tínhamos visto na nossa vida.
Os agricultores do vale cultivam maçãs, trigo e muitos legumes.
O telefone novo é mais barato do que aquele que eu queria comprar no ano passado.
Onde é que aprendeste a tocar tão bem violão?
Toda a pessoa tem direito ao repouso e a férias pagas.""",
    "ru": """Дети пошли домой пешком, потому что автобус опять опоздал.
Она купила на рынке хлеб, немного сыра и две бутылки воды.
Мой брат живёт у моря с тех пор, как ему исполнилось двенадцать лет.
Если завтра пойдёт дождь, мы останемся дома и посмотрим старый фильм.
Никто не знал, почему свет на кухне погас так рано.
Он спросил, хватит ли времени сходить в музей до обеда.
Врач сказал им, что надо пить больше воды и дольше спать.
Все люди рождаются свободными и равными в своём достоинстве и правах.
Что ты хочешь съесть сегодня вечером, рыбу или курицу с рисом?
Они работают в саду с самого утра.
Поезд на север отходит в восемь и прибывает незадолго до полудня.
Я не помню, куда положил ключи, которые ты дал мне вчера.
Тысячи людей приехали в город, чтобы послушать музыку этой группы.
Наши соседи очень добры, хотя их собака лает всю ночь.
Пожалуйста, напишите здесь своё имя и верните письмо как можно скорее.
Это был самый красивый дом, который мы когда-либо видели.
Крестьяне в долине выращивают яблоки, пшеницу и разные овощи.
Где ты научился так хорошо играть на гитаре?""",
    "zh": """因为公共汽车又晚了，孩子们从学校走路回家。
她在市场上买了一些面包、一点奶酪和两瓶水。
我的哥哥从十二岁起就住在海边。
如果明天下雨，我们就留在家里看一部老电影。
没有人知道厨房的灯为什么这么早就灭了。
他问午饭之前有没有足够的时间去参观博物馆。
医生告诉他们应该多喝水，早点睡觉。
人人生而自由，在尊严和权利上一律平等。
你今天晚上想吃什么，鱼还是鸡肉米饭？
他们从清早起就在花园里干活。
去北方的火车八点开，快到中午的时候到。
我不记得把你昨天给我的钥匙放在哪里了。
成千上万的人来到城里听这个乐队的音乐。
我们的邻居很友好，虽然他们的狗整夜叫个不停。
请在这里写上您的名字，并尽快把信寄回来。
那是我们一生中见过的最漂亮的房子。
山谷里的农民种苹果、小麦和各种蔬菜。
这个新手机比我去年想买的那个便宜。
你在哪里学会弹吉他弹得这么好？
人人有享有休息和闲暇的权利。""",
    "ja": """バスがまた遅れたので、子どもたちは学校から歩いて帰りました。
彼女は市場でパンとチーズを少し、それから水を二本買った。
兄は十二歳の時から海の近くに住んでいます。
明日雨が降ったら、家にいて古い映画を見ましょう。
台所の電気がなぜそんなに早く消えたのか、誰も知らなかった。
彼は昼ご飯の前に博物館に行く時間があるかと尋ねた。
医者は彼らに、もっと水を飲んで長く眠るようにと言いました。
すべての人間は、生まれながらにして自由であり、尊厳と権利とについて平等である。
今晩は何を食べたいですか、魚ですか、それとも鶏肉とご飯ですか。
彼らは朝早くから庭で働いている。
北へ行く列車は八時に出て、昼前に着きます。
昨日もらった鍵をどこに置いたか覚えていません。
何千人もの人がその音楽を聞くために町に来た。
隣の人たちはとても親切ですが、犬が一晩中ほえています。
ここに名前を書いて、できるだけ早く手紙を送り返してください。
それは私たちが今までに見た中で一番きれいな家だった。
谷の農家はりんごや小麦やいろいろな野菜を作っている。
新しい電話は去年買いたかったものより安い。
どこでそんなに上手にギターを弾くことを習ったのですか。""",
    "th": """เด็กๆ เดินกลับบ้านจากโรงเรียนเพราะรถเมล์มาสายอีกแล้ว
เธอซื้อขนมปัง ชีสนิดหน่อย และน้ำสองขวดที่ตลาด
พี่ชายของฉันอยู่ใกล้ทะเลตั้งแต่อายุสิบสองปี
ถ้าพรุ่งนี้ฝนตก เราจะอยู่บ้านดูหนังเก่าด้วยกัน
ไม่มีใครรู้ว่าทำไมไฟในครัวถึงดับเร็วขนาดนั้น
เขาถามว่ามีเวลาพอที่จะไปพิพิธภัณฑ์ก่อนอาหารกลางวันหรือไม่
หมอบอกพวกเขาว่าควรดื่มน้ำมากขึ้นและนอนให้นานขึ้น
มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ
คืนนี้คุณอยากกินอะไร ปลาหรือไก่กับข้าว
พวกเขาทำงานในสวนตั้งแต่เช้าตรู่
รถไฟไปทางเหนือออกแปดโมงและถึงก่อนเที่ยงเล็กน้อย
ฉันจำไม่ได้ว่าวางกุญแจที่คุณให้เมื่อวานไว้ที่ไหน
เพื่อนบ้านของเราใจดีมากแม้ว่าหมาของเขาจะเห่าทั้งคืน
ชาวนาในหุบเขาปลูกแอปเปิล ข้าวสาลี และผักหลายชนิด""",
    "hi": """बस फिर देर से आई, इसलिए बच्चे स्कूल से पैदल घर गए।
उसने बाज़ार से रोटी, थोड़ा पनीर और पानी की दो बोतलें खरीदीं।
मेरा भाई बारह साल की उम्र से समुद्र के पास रहता है।
अगर कल बारिश हुई तो हम घर पर रहकर एक पुरानी फ़िल्म देखेंगे।
किसी को नहीं पता था कि रसोई की बत्ती इतनी जल्दी क्यों बुझ गई।
उसने पूछा कि क्या दोपहर के खाने से पहले संग्रहालय देखने का समय है।
डॉक्टर ने उनसे कहा कि उन्हें ज़्यादा पानी पीना और देर तक सोना चाहिए।
सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है।
आज रात तुम क्या खाना चाहते हो, मछली या चावल के साथ मुर्गा?
वे सुबह से बगीचे में काम कर रहे हैं।
उत्तर जाने वाली गाड़ी आठ बजे चलती है और दोपहर से कुछ पहले पहुँचती है।
मुझे याद नहीं कि तुमने कल जो चाबियाँ दी थीं, वे मैंने कहाँ रखीं।
हमारे पड़ोसी बहुत अच्छे हैं, हालाँकि उनका कुत्ता रात भर भौंकता है।
कृपया यहाँ अपना नाम लिखिए और चिट्ठी जल्दी लौटा दीजिए।
घाटी के किसान सेब, गेहूँ और तरह-तरह की सब्ज़ियाँ उगाते हैं।""",
}

# Sentences of other languages of the same scripts, which are to be rejected.
OTHER = {
    "it": """I bambini sono tornati a piedi da scuola perché l’autobus era di nuovo in ritardo.
Ha comprato del pane, un po’ di formaggio e due bottiglie d’acqua al mercato.
Se domani piove, resteremo a casa e guarderemo un vecchio film insieme.
Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.
Nessuno sapeva perché la luce della cucina si fosse spenta così presto.
Il medico ha detto loro che dovevano bere più acqua e dormire di più.
Non ricordo dove ho messo le chiavi che mi hai dato ieri.
Dove hai imparato a suonare così bene la chitarra?""",
    "nl": """De kinderen liepen van school naar huis omdat de bus weer te laat was.
Zij kocht wat brood, een beetje kaas en twee flessen water op de markt.
Als het morgen regent, blijven we thuis en kijken we samen naar een oude film.
Alle mensen worden vrij en gelijk in waardigheid en rechten geboren.
Niemand wist waarom het licht in de keuken zo vroeg was uitgegaan.
De dokter zei dat ze meer water moesten drinken en langer moesten slapen.
Ik weet niet meer waar ik de sleutels heb gelegd die je me gisteren gaf.
Waar heb je zo goed gitaar leren spelen?""",
    "pl": """Dzieci wróciły pieszo ze szkoły, ponieważ autobus znowu się spóźnił.
Kupiła na targu chleb, trochę sera i dwie butelki wody.
Jeśli jutro będzie padać, zostaniemy w domu i obejrzymy stary film.
Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.
Nikt nie wiedział, dlaczego światło w kuchni zgasło tak wcześnie.
Lekarz powiedział im, że powinni pić więcej wody i dłużej spać.
Nie pamiętam, gdzie położyłem klucze, które mi wczoraj dałeś.
Gdzie nauczyłeś się tak dobrze grać na gitarze?""",
    "sv": """Barnen gick hem från skolan eftersom bussen var sen igen.
Hon köpte lite bröd, ost och två flaskor vatten på torget.
Om det regnar i morgon stannar vi hemma och ser en gammal film tillsammans.
Alla människor är födda fria och lika i värde och rättigheter.
Ingen visste varför ljuset i köket hade slocknat så tidigt.
Läkaren sade att de borde dricka mer vatten och sova längre.""",
    "tr": """Otobüs yine geç kaldığı için çocuklar okuldan eve yürüdüler.
Pazardan biraz ekmek, peynir ve iki şişe su aldı.
Yarın yağmur yağarsa evde kalıp eski bir film izleriz.
Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.
Mutfaktaki ışığın neden bu kadar erken söndüğünü kimse bilmiyordu.
Dün bana verdiğin anahtarları nereye koyduğumu hatırlamıyorum.""",
    "id": """Anak-anak berjalan pulang dari sekolah karena bus terlambat lagi.
Dia membeli roti, sedikit keju dan dua botol air di pasar.
Kalau besok hujan, kami akan tinggal di rumah dan menonton film lama.
Semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama.
Tidak ada yang tahu mengapa lampu dapur padam begitu cepat.""",
    "ro": """Copiii s-au întors pe jos de la școală pentru că autobuzul a întârziat din nou.
A cumpărat pâine, puțină brânză și două sticle de apă de la piață.
Toate ființele umane se nasc libere și egale în demnitate și în drepturi.
Nimeni nu știa de ce lumina din bucătărie se stinsese atât de devreme.""",
    "cs": """Děti šly ze školy domů pěšky, protože autobus měl zase zpoždění.
Koupila na trhu chléb, trochu sýra a dvě láhve vody.
Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv.
Nikdo nevěděl, proč světlo v kuchyni zhaslo tak brzy.""",
    "vi": """Bọn trẻ đi bộ từ trường về nhà vì xe buýt lại đến muộn.
Cô ấy mua bánh mì, một ít pho mát và hai chai nước ở chợ.
Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi.""",
    "uk": """Діти пішли додому пішки, бо автобус знову запізнився.
Вона купила на ринку хліб, трохи сиру і дві пляшки води.
Якщо завтра піде дощ, ми залишимося вдома і подивимося старий фільм.
Всі люди народжуються вільними і рівними у своїй гідності та правах.
Ніхто не знав, чому світло на кухні згасло так рано.""",
    "bg": """Децата се прибраха пеша от училище, защото автобусът пак закъсня.
Тя купи от пазара хляб, малко сирене и две бутилки вода.
Всички хора се раждат свободни и равни по достойнство и права.""",
    "mr": """बस पुन्हा उशिरा आल्यामुळे मुले शाळेतून पायी घरी गेली.
तिने बाजारातून भाकरी, थोडे चीज आणि पाण्याच्या दोन बाटल्या विकत घेतल्या.
सर्व मानवी व्यक्ती जन्मतःच स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत.""",
}
