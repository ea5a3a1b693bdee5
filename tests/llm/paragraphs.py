"""Short paragraphs of ordinary prose in languages that the corpus does not have, written for these tests."""

PROSE = {
    "pt": "Ontem à tarde fomos até à praia porque o tempo estava finalmente bom. As crianças brincaram na areia durante horas, enquanto os avós liam o jornal à sombra de um velho guarda-sol. Quando o sol se pôs, voltámos a pé para casa e preparámos uma sopa simples.",
    "it": "Mia sorella ha comprato una vecchia bicicletta al mercato e adesso la sta riparando nel garage. Dice che non vuole spendere altri soldi, ma ogni settimana torna a casa con un pezzo nuovo. Secondo me alla fine costerà più di una bicicletta appena uscita dalla fabbrica.",
    "pl": "Wczoraj wieczorem nad jeziorem zebrała się gęsta mgła, więc postanowiliśmy zostać w domu. Babcia opowiadała nam o swojej młodości, a dziadek udawał, że śpi w fotelu. Dopiero gdy usłyszał swoje imię, otworzył oczy i zaczął się śmiać razem z nami.",
    "nl": "Vorige week hebben we met de buren een oude schuur opgeruimd die al jaren leeg stond. Niemand wist nog van wie de spullen waren, dus besloten we alles op straat te zetten. Binnen een uur was bijna alles weg en hadden we ruimte voor een kleine werkplaats.",
    "sv": "När snön äntligen hade smält bort gick vi ut för att se hur trädgården mådde. De flesta växterna hade klarat sig bra, men det gamla äppelträdet var skadat av vinden. Vi bestämde oss för att vänta till våren innan vi gör något åt det.",
    "fi": "Viime kesänä matkustimme junalla pohjoiseen, koska halusimme nähdä yöttömän yön omin silmin. Matka kesti kauan, mutta ikkunasta näkyi metsää, järviä ja pieniä kyliä. Perillä meitä odotti vanha ystävä, joka oli jo keittänyt kahvia ja lämmittänyt saunan.",
    "tr": "Dün sabah pazara gittiğimde yağmur yağıyordu ve sokaklar bomboştu. Yaşlı bir adam bana en tatlı kavunların nerede olduğunu gösterdi, ben de ondan iki tane aldım. Eve döndüğümde çocuklar çoktan uyanmış, kahvaltı için beni bekliyorlardı.",
    "cs": "Když jsme přijeli do vesnice, byla už tma a na návsi nesvítila ani jedna lampa. Naštěstí nás čekal strýc, který nás odvedl k sobě domů a uvařil nám horký čaj. Ráno jsme zjistili, že jsme celou dobu stáli jen pár kroků od jeho dveří.",
    "vi": "Sáng nay tôi dậy sớm để đi chợ cùng với mẹ vì bà muốn mua cá tươi. Trời hơi lạnh nhưng mọi người trong chợ vẫn nói cười rất vui vẻ. Khi về đến nhà, chúng tôi cùng nhau nấu một nồi canh chua cho cả gia đình.",
    "id": "Kemarin kami pergi ke gunung untuk melihat matahari terbit, tetapi kabutnya terlalu tebal. Walaupun begitu, kami tetap senang karena udaranya segar dan tidak ada suara kendaraan. Dalam perjalanan pulang, kami berhenti di sebuah warung kecil dan minum teh hangat.",
    "el": "Χθες το βράδυ καθίσαμε στην αυλή και μιλούσαμε για τα παλιά χρόνια μέχρι που νύχτωσε. Ο παππούς θυμήθηκε πώς έμαθε να κολυμπά, ενώ η γιαγιά έλεγε ότι τα μισά ήταν ψέματα. Στο τέλος γελούσαμε όλοι, χωρίς να ξέρουμε πια γιατί.",
    "uk": "Минулої неділі ми вирішили посадити кілька дерев біля старої школи. Спочатку ніхто не знав, де взяти лопати, але сусід приніс одразу п'ять. До вечора ми дуже втомилися, зате тепер там росте маленький сад, яким усі пишаються.",
    "ar": "في صباح يوم الجمعة ذهبنا إلى السوق القديم لأن أمي أرادت أن تشتري بعض الفواكه. كان المكان مزدحماً جداً، لكن البائع تذكرنا وأعطانا سعراً جيداً. بعد ذلك جلسنا في مقهى صغير وشربنا الشاي حتى الظهر.",
    "he": "בשבוע שעבר נסענו לבקר את הדודה שלי שגרה בכפר קטן ליד הים. היא הכינה לנו ארוחה גדולה וסיפרה על הימים שבהם עבדה כמורה בבית הספר. כשחזרנו הביתה בלילה, הילדים כבר ישנו במושב האחורי של המכונית.",
    "hi": "कल शाम को हम सब नदी के किनारे घूमने गए, क्योंकि घर के अंदर बहुत गर्मी थी। वहाँ कुछ बच्चे पतंग उड़ा रहे थे और उनकी माँ उन्हें दूर से देख रही थी। जब अँधेरा होने लगा, तो हमने चाय पी और धीरे-धीरे घर लौट आए।",
    "ko": "지난 주말에 우리는 오래된 기차를 타고 바다를 보러 갔다. 날씨가 조금 흐렸지만 사람이 많지 않아서 조용히 걸을 수 있었다. 저녁에는 작은 식당에서 생선 요리를 먹고, 밤늦게 집으로 돌아왔다.",
    "zh": "昨天下午,我和弟弟一起去公园散步。天气很好,湖边有许多人在放风筝,也有人坐在树下看书。我们走了大约一个小时,后来觉得有点累,就在一家小店里喝了杯茶。回家的路上,弟弟说他下个星期还想再来。",
    "th": "เมื่อวานนี้ฉันกับเพื่อนไปเดินเล่นที่ตลาดริมน้ำ อากาศค่อนข้างร้อนแต่มีลมพัดเบาๆ เราแวะกินก๋วยเตี๋ยวร้านเล็กๆ แล้วนั่งคุยกันเรื่องงานใหม่ของเธอ ตอนเย็นฝนตกลงมา เราจึงต้องวิ่งกลับบ้าน",
}

JUNK = {
    "function words": "the of and to in that is was for it with as his on be at by I this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up " * 3,
    "few function words": "the of and to in that " * 20,
    "bare nouns": "anchor kettle garden window copper ladder silver basket harbor pencil marble lantern pillow hammer rocket saddle velvet timber bottle castle candle pepper button turnip needle violin orange carpet bridge mirror " * 2,
    "home row": "asdf jkl sdfkj lsdkfj asdlkfj sldkfj asdjfh kjasdhf lkjsadhf qwoeiru zxmcnvb sdkfjh asldkjf hskdjfh weiruy xcvmnb lkjhsdf oiuwer mnbxcv sdfkjhw",
    "table": "| name | size | state |\n|---|---|---|\n| alpha | 12 | ok |\n| beta | 7 | failed |\n| gamma | 99 | ok |\n| delta | 4 | |",
    "menu": "Home\nAbout us\nProducts\nContact\nSitemap\nLogin\nRegister\nCart\nHelp\nTerms\nPrivacy\nJobs",
    "log": "2024-03-01 10:22:31,456 ERROR [pool-3] conn.c:88 timeout after 3000ms host=10.0.0.12\n2024-03-01 10:22:32,001 WARN [pool-3] retry 1/5 host=10.0.0.12\n2024-03-01 10:22:35,120 INFO [pool-1] closed id=77ab12",
    "code": "for (int i = 0; i < n; i++) {\n    sum += a[i] * b[i];\n    if (sum > LIMIT) { break; }\n}\nreturn sum / (double) n;",
    "base64": "TWFuIGlzIGRpc3Rpbmd1aXNoZWQsIG5vdCBvbmx5IGJ5IGhpcyByZWFzb24sIGJ1dCBieSB0aGlzIHNpbmd1bGFyIHBhc3Npb24gZnJvbSBvdGhlciBhbmltYWxz\n" * 3,
    "laugh": "hahahahahahahahahahahahahahahahahahahahahahahahahahaha",
}
