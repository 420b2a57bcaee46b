"""The small labelled table of problem 10: sentences put together from general grammars of ten languages.

A sentence is a frame with typed slots: {P} person, {L} family name after a title, {E} email,
{T} phone, {I} identity number, {A} address, {H} Chinese or Japanese name, {C} Chinese address;
{F} firm, {R} road, {G} place, {N} digits and {W} an invented word carry no label. Names are
common names of many countries or invented syllables, so that the field has to go by shape and
context. Nothing here is taken from a table the operator is used on.
"""

from __future__ import annotations

import random

# Frames with personal data, by language.
FRAMES = {
    "en": """
Dear {P}, | Dear Mr {L}, | Dear Ms. {L}, | Hello {P}, | Yours sincerely,\\n{P} | Best wishes, {P} | Many thanks, {P} | Sincerely, {P}
{P} called us yesterday. | {P} was present. | {P} has left the company. | {P} and {P} agreed. | {P}, {P} and {P} voted against. | {P} is on leave until Monday.
We spoke to {P} about the {W}. | The letter was written by {P}. | The {W} was checked by {P} and {P}. | It is {P} who decides. | It was {P} that asked. | I met {P} last week. | Approved by {P}. | Prepared by {P} | Signed: {P}
The {W} of {P} was refused. | {P}’s {W} is overdue. | {P}'s {W} went up. | Thanks to {P}, the {W} was found. | According to {P}, nothing was lost. | {P} said the {W} was late.
Mr {L} wrote back. | Mrs {L} agreed. | Dr {L} and Dr. {L} were absent. | Prof. {L} spoke first. | Ask Mr. {P} or Mrs. {P}. | Ms {P} will answer, {E}. | Ms {P}, {E} | Sir {P} was honoured. | Miss {L} sent it from {E}.
The customer, {P}, resides in {A}. | {P} moved to {A}. | {P}, {A}, asked for help. | Deliver to {A}, for {P}. | Deliver to {A}, c/o {P}. | The house at {A} burned down. | Our office is at {A}. | Going to {A} took an hour. | {A} was sold. | He lives in {A}. | From {A} we drove home.
{P}\\n{A} | {P}\\n{A}\\n{T} | Name: {P}\\nAddress: {A}\\nPhone: {T} | Name: {P} | Address: {A} | {P}\\n{A}\\n{T}\\n{E} | Owner\\n{P}\\n{A}\\n{T} | Recipient:\\n{P}\\n{A}
Ring {P} at {T}. | Phone {T} or write to {E}. | Telephone: {T} | Call me on {T}. | You can reach {P} under {T} until noon. | His mobile is {T}, ext. {N}. | Fax {T} | The line {T} is dead. | tel. {T} | Tel: {T}; email: {E} | Dial {T} for help. | the caller left {T} as a number | WhatsApp {T} | {P} ({T}) | {P}, {T}, {E}
Mail me at {E}. | Write to {E}; {E} | E-mail: {E} | {E} | copy to {E}, {E} | Reply from {E} arrived. | bcc {E} | <{E}> bounced. | contact {E} or {T} | contacted at {E} in May | send the papers to {E} or dial {T} ext. {N}.
His passport no. is {I}. | ID card {I} | SSN {I} | National insurance number {I} was missing. | identity number: {I}; phone {T}; e-mail {E} | The holder {P} (ID {I}) agreed. | Case ({I}, {T}) is open. | Passport {I} expired. | {P}, born in {G}, passport {I}, left. | document {I} of {P} | id {I} | The number {I} belongs to {P}. | the client ({I}, {E}) wrote
""",
    "de": """
Sehr geehrter Herr {L}, | Sehr geehrte Frau {L}, | Lieber {P}, | Mit freundlichen Grüßen\\n{P} | Ihr {P} | {P} hat angerufen. | {P} war nicht da. | Das {W} schrieb {P}. | Den Brief verfasste {P}. | Herr {P} kommt morgen. | Frau {P} antwortet unter {T}. | Herr {L} ist unter {T} erreichbar. | Frau {L} ging um {N} Uhr. | Wir danken {P} und {P}. | Unterzeichnet von {P}.
Der Kunde {P}, wohnt {A}, klagt. | Die Kundin {P} aus {A} zahlt. | Lieferung an {P}, {A}, Telefon {T}. | Adresse: {A} | Wohnhaft: {A}. | Das Haus {A} steht leer. | {P}\\n{A} | Post bitte an {E} richten. | Mail: {E} | Telefon {T}, Fax {T} | Reisepass {I} von Herrn {P} | Personalausweis {I} liegt bei, zuständig ist Frau {P}. | Ausweisnummer {I} fehlt. | Rufen Sie {T} an. | Ansprechpartnerin: {P}, {T} | Dr. {L} und Prof. {L} fehlten. | Laut {P} war alles gut. | Es fragt {P}.
""",
    "fr": """
Cher Monsieur {L}, | Chère Madame {L}, | Bonjour {P}, | Cordialement,\\n{P} | {P} a téléphoné. | {P} était absent. | Le {W} a été rédigé par {P}. | Lettre envoyée à {P} hier. | M. {P} viendra demain. | Mme {P} répond au {T}. | M. {L} et Mme {L} sont venus. | Le client, M. {P}, habitant {A}, paie. | {P} habite {A}. | Envoyez le colis à {P}, {A} ; tél. {T}. | Adresse : {A} | {A} ; téléphone {T} | Adresse du client : {A}. | Courriel : {E} | Écrivez à {E} ou appelez le {T}. | Joindre {P} au {T}. | Passeport no. {I} remis par M. {P}. | Carte d’identité {I} de Mme {P}. | Numéro {I} contrôlé par {P} | {P}\\n{A}\\n{T} | Selon {P}, tout va bien. | Remis à {P} le matin. | Signé : {P} | Merci à {P} et {P}.
""",
    "es": """
Estimado señor {L}: | Estimada Sra. {L}, | Hola {P}, | Atentamente,\\n{P} | {P} llamó ayer. | {P} no vino. | La carta fue escrita por {P}. | El {W} lo firmó {P} en {A}. | Redactado por {P}, en {A}. | Don {P} viene mañana. | El cliente, don {P}, residente en {A}, pagó. | La clienta, doña {P}, vecina de {A}, pagó. | Vive en {A}. | Domicilio: {A}. | Dirección: {A} | Teléfono {T}, correo {E} | Escriba a {E} o marque el {T}. | Contacte con {P}, tel. {T}, {E}. | Persona de contacto: {P}, tel. {T} | Pasaporte {I} revisado por {P}. | Documento nacional {I} de {P} | El Sr. {L} y la Sra. {L} hablaron. | Según {P}, no hay dudas. | Gracias a {P} y {P}. | Envíe el paquete a {P}, {A}.
""",
    "pt": """
Caro senhor {L}, | Olá {P}, | Atenciosamente,\\n{P} | {P} ligou ontem. | {P} não veio. | A carta foi escrita por {P}. | Fale com {P}, tel. {T}, {E}. | O cliente, o sr. {P}, morador em {A}, pagou. | Mora em {A}. | Telefone {T} ou correio {E}. | Passaporte {I} visto por {P}. | Pergunte a {P}, {E}. | A sra. {L} saiu. | Segundo {P}, está tudo bem.
""",
    "ru": """
Уважаемый господин {L}, | С уважением,\\n{P} | Звонила {P}. | Письмо подписал {P}. | Исполнитель {P}, телефон {T}, {E}. | Пишите на {E} или звоните {T}. | Паспорт {I}, владелец {P}. | Контакт: {P}, {T} | Адрес: {A} | Спросите {P}. | тел. {T}, почта {E}
""",
    "zh": """
尊敬的{H}先生： | {H}女士来电。 | 由{H}负责。 | 本报告由{H}撰写。 | 记录由{H}完成。 | 记录由{P}完成。 | 经办人：{H}，手机{T}。 | 经办人：{P}，手机{T}。 | 请联系{H}，{T}。 | 请联系{P}，{T}。 | 收件人{H}，地址{C}。 | 客户{H}的护照号是{I}。 | 客户{P}的护照号是{I}。 | 申请者{H}住在{C}，身份证{I}。 | 申请者{P}住在{C}，身份证{I}。 | 身份证号{I}有误。 | 护照{I}已过期。 | 文件送到{C}，{H}签收。 | 文件送到{C}，{P}签收。 | 请发邮件到 {E} 。 | 邮箱：{E} | 电话：{T} | 致电{T}咨询。 | {H}说明了情况。 | {H}和{H}没有出席。 | 住址：{C} | 他住在{C}。 | 签字：{H} | 请把包裹寄给{H}。 | 感谢{H}的帮助。 | 被保人{H}、受益人{H}。 | 案件（{I}，{T}）待处理。
""",
    "ja": """
{H}様 | 担当：{H}（{T}） | {H}さんから連絡がありました。 | 連絡先は{P}、{T}です。 | 作成者は{H}です。 | 電話番号：{T} | メール：{E} | 旅券番号{I}を確認した。 | {H}氏が署名した。 | 問い合わせは {E} まで。
""",
    "th": "ติดต่อ {P} โทร {T} | อีเมล {E} | โทรศัพท์ {T} | หนังสือเดินทาง {I}",
    "hi": "संपर्क {P}, फ़ोन {T} | ईमेल {E} | फ़ोन {T} | पासपोर्ट {I}",
}

# Nouns for the part a person plays and for papers with numbers, by language.
ROLES = {
    "en": "Customer|Client|Claimant|Policyholder|Beneficiary|Applicant|Owner|Tenant|Patient|Employee|Manager|Director|Chairman|Secretary|Witness|Buyer|Seller|Agent|Insured|Member|Recipient|Driver|Doctor|Guest|Contact person|Account holder|Next of kin|Reporter|Attendee",
    "de": "Der Kunde|Die Kundin|Der Versicherungsnehmer|Die Antragstellerin|Der Mieter|Die Patientin|Der Zeuge|Der Leiter|Die Leiterin|Der Beschwerdeführer|Der Fahrer|Ansprechpartner|Empfänger|Der Inhaber|Die Ärztin",
    "fr": "Le client|La cliente|Le souscripteur|Le titulaire|Le locataire|Le témoin|La patiente|Le directeur|L’abonné|L’abonnée|L’assurée|L’employé|Destinataire|Le conducteur|Le demandeur",
    "es": "El cliente|La clienta|El titular|El tomador|El inquilino|La testigo|El director|La directora|El empleado|El solicitante|La paciente|El beneficiario",
    "pt": "O cliente|A cliente|O titular|O segurado|A inquilina|O diretor|O paciente",
    "ru": "Клиент|Заявитель|Директор|Свидетель|Пациент|Ответственная",
    "zh": "客户|申请人|投保者|受益人|经理|证人|患者|收件人|车主|负责人|主任|代理人|员工|会员",
    "ja": "担当|責任者|申込者|受取人|部長",
    "th": "ลูกค้า|ผู้จัดการ",
    "hi": "ग्राहक|प्रबंधक",
}
PAPERS = {
    "en": "Invoice|Order|Voucher|Receipt|Ticket|Entry|Contract|Policy|Lot|Batch|Claim|Reference|Purchase order|Account|Serial no.|Code|Item|File|Docket",
    "de": "Rechnung|Beleg|Auftrag|Bestellung|Vertrag|Quittung|Buchung|Los|Akte|Vorgang",
    "fr": "La facture|Le bordereau|La commande|Le contrat|Le reçu|Le dossier|Le lot|La pièce",
    "es": "La factura|El pedido|El recibo|El contrato|El expediente|El lote|El comprobante",
    "pt": "A fatura|O pedido|O recibo|O contrato|O processo",
    "ru": "Счёт|Заказ|Договор|Накладная",
    "zh": "凭证|单据|订单|发票|合同号|凭证号|单号|批次|保单号|票据",
    "ja": "伝票|注文|請求書|契約番号",
    "th": "ใบสั่งซื้อ|ใบแจ้งหนี้",
    "hi": "चालान|आदेश",
}
LANDS_HAN = "中国 日本 韩国 泰国 越南 新加坡 马来西亚 印度尼西亚 菲律宾 印度 澳大利亚 德国 法国 英国 美国 加拿大 俄罗斯 西班牙 葡萄牙 巴西 墨西哥 香港 澳门 台湾 北京 上海 深圳 广州 成都 太平洋 亚洲 欧洲 内地 海外".split()

# Frames by role, added to those of every language; {O} is a role.
ROLE_FRAMES = {
    "": """
{O} {P} | {O}: {P} | {O} {P} ({I}) | {O} {P} (ID {I}) | {O}\n{P} | {O}\n{P}\n{A}\n{T} | {O}: {P}, {T}, {E} | {O}: {P}\n{A} | {O} {P}, {A}, {T} | {P}, {A}, {T}. | {A}, {P} | {A}\n{P} | {P}; {P} | {P}, {P} | {P}; {P}; {P} | {I} | {I}; {T}; {E} | {T} / {E} | {E}, {T}. | {P} {T}
""",
    "en": """
Please ring {P} on {T} today. | Call {P} on {T} before noon. | {P} did not reply. | {P} cannot be reached. | {A}, {P} was seen. | {P}’s house is sold. | {P}'s letter came. | Mr {L} called. | Mr {L} wrote from {E}. | Mrs {L} rang from {T}. | {O} {P} wants a copy. | {O} {P} did not come. | the {w} {P} signed | {O} {P} of {A} wrote. | At {A}, {P} answers on {T}. | Mail it to {A}, to the attention of {P}. | Since {P} moved to {A}, {P} is at {T}. | Notes taken by {P}; {P} and {P} left early. | It is {P} who signs. | Was it {P} who called? | Checked by {P} and Dr. {P}. {P}’s file is closed. | Regards, {P} | Kindest regards {P} | With {P} gone, the {w} stopped. | Ms {P}, {T} | Mr {L} answered from {E} at once. | Mr {P} and Mrs {L} | the {w} ({I}, {T}) was shut | tax id: {I}; phone {T}; mail {E} | personal id {I} | Address of the {w}: {A}. | They met at {A} and left. | Dr. {P}, {P} and Prof. {L}
""",
    "de": """
{O} {P}, wohnhaft in {A}, schreibt. | Frau {P}, wohnhaft {A}, schreibt. | wohnhaft {A} | Den Vorsitz hatte {P}. | Es sprach {P}. | Anwesend war {P}. | Post an {P}, {A}, Tel. {T}. | Paket an {P}, {A}, Telefon {T}. | Die Feier leitete {P}. | {O} {P}, wohnt in {A}, schreibt. | {O} {P}, {A}, zahlt nicht. | An {P}, {A}, Tel. {T}. | Zu Händen von {P}, {A}, Telefon {T}. | Steuer-Nr. {I} von {P} | Pass-Nr. {I} fehlt, zuständig ist Herr {P}. | Fragen an Herrn {P} unter {T}. | Fragen an Frau {P}, {T}. | Die Notizen stammen von {P}. | Das Gespräch leitete {P}. | Herr {P} war nicht zu sprechen. | Herr {L}, Tel. {T}, ist krank.
""",
    "fr": """
{O}, M. {P}, habitant {A}, accepte. | {O}, Mme {P}, domiciliée {A}, accepte. | Le courrier pour {P} est parti. | À envoyer à {P}, {A} ; tél. {T}. | Passeport no. {I} lu par Mme {P}. | Écrire à {E} ou téléphoner au {T}. | M. {P}, {T} | {P} a signé la veille.
""",
    "es": """
Reunión con {P} en {A}. | La visita a {A} terminó. | {O}, don {P}, que vive en {A}, acepta. | {O}, doña {P}, de {A}, acepta. | Nota escrita por {P} en {A}. | Pasaporte {I} visto por {P}. | Preguntas a {E} o al {T}. | Atiende {P}, tel. {T}, {E}.
""",
    "pt": "{O}, o sr. {P}, de {A}, aceita. | Atende {P}, tel. {T}, {E}. | Perguntas para {E} ou {T}.",
    "ru": "{O} {P}, тел. {T}, {E}. | {O} — {P}. | Спрашивать: {P}",
    "zh": """
{O}{H}的护照为{I}。 | {O}{P}的护照为{I}。 | {O}{H}的电话是{T}。 | {O}{H}家住{C}，护照{I}。 | {O}{P}家住{C}，护照{I}。 | {O}{H}居住于{C}。 | {O}{H}现住{C}，号码{I}。 | 请寄到{C}，{H}亲启。 | 快递到{C}，{H}收。 | 快递到{C}，{P}收。 | 信寄往{C}，{H}收。 | 速送{C}，{H}收 | 日程由{H}整理。 | 名单由{P}整理。 | 请寄到{C}，{P}亲启。 | 笔记由{H}完成。 | 文件由{H}保管。 | 本文由{P}翻译。 | {O}：{H}，电话{T}。 | {O}：{P}，电话{T}。 | {O}：{H} | 由{P}翻译。 | 地址{C}，{H}转交。
""",
    "ja": "{O}は{H}です。 | {O}は{P}、電話{T}。 | {O}：{H}",
}

# Frames of papers with numbers, added to those without personal data; {V} is a paper.
PAPER_FRAMES = {
    "": """
{V} {N4}-0{D}{D}-{N4} | {V} {N4}-{N4} | {V} {N}{N4} | {V} {N4}/{N4}/{D}{D} | {V} {U}-{N4} | {V} {N4}-{N4}-{N4} | {V} {N}.{N}.{N} | 20{D}{D}-1{D}-0{D} | 0{D}.1{D}.20{D}{D} | {V} no. {N4}-0{D}{D}-{N4}
""",
    "en": "I've {w}, we'll {w} and they're {w}. | don't {w} | I'M {W}, YOU'VE {W} | {w}; {w} {W1} was {w} | {V} {N4}-0{D}{D}-{N4} belongs to lot {D}{D}-{D}{D}. | {V} {U}-{N4} goes to form {N}. | {V} {N4}{N4} was cleared on 20{D}{D}-0{D}-1{D}. | {V} {N4}-0{D}{D}-{N4} of {F}",
    "de": "Der Rat hat die {W1} beschlossen; höhere {W1} war der Grund. | Die {W1} fiel; {w}e {W1} sind schuld. | Der {W1} und {w}e {W1} | Kleinere {W1} und größere {W1} | {V} {N4}-0{D}{D}-{N4} geht an die {f} AG. | Einige {W1}, z. B. {G}, sind zu klein. | Viele {W1}, z. B. {G}, haben mehr {W1}. | Alle {W1}, d. h. {W1}, fallen weg. | Manche {W1}, u. a. {G}, sind neu. | Einige {W1} meldeten {W1}. | Diese {W1} sind {w}. | z. B. {G} | Mehrere {W1}, etwa {G}, wuchsen. | {W1} nach {W1} | Hinweise zu {W1}",
    "fr": "{V} {N4}-0{D}{D}-{N4} concerne {F}. | {V} {N4}-{N4} est payée. | p. ex. {G} | Par exemple, {G} reste faible.",
    "es": "{V} {N4}-0{D}{D}-{N4} es de {F}. | {V} {N4}-{N4} llegó. | por ej. {G}",
    "pt": "{V} {N4}-0{D}{D}-{N4} é da {F}. | por ex. {G}",
    "zh": "{V}{N4}-0{D}{D}-{N4}被退回。 | {V}{N4}{N4}无效。 | 附注：{Z}的{K}自20{D}{D}年调整。 | {Z}的{K}下降至{N}.{D}%。 | （{Z}的{K}未核对。） | {Z}{K}上升。 | 由于{K}，{Z}的{K}会变差吗？ | 到20{D}{D}年底，{Z}的{K}高于{Z}。 | 会议问{Z}的{K}。 | {Z}和{Z}的{K}不一样。",
    "ja": "{V}{N4}-{N4}は無効です。 | {Z}の{K}は下がった。",
}

# Frames without personal data, of firms, roads, places, headings, amounts and reference numbers.
PLAIN = {
    "en": """
{F} bought {F}. | {F} opened a branch in {G}. | {F} was advised by {F}. | {f} & {f} Partners drew up the paper. | {f}, {f} & Co. audited it. | The {f} Group grew. | {f} Holdings Inc. raised capital. | {f} Bank plc lent {N} million. | {f} Insurance Ltd. paid. | A contract with {f} Assurance Co. for {G} ended.
The {R} project cost {N} million. | {R} works take {N} months. | A bridge on {R} is closed. | The {R} toll rose. | {R} bonds were sold. | The {R} note pays {D}%.
Sales in {G} rose by {N}.{D}%. | In {G}, the {W} fell. | {G} and {G} did better. | {G} was weaker than {G}. | The {W} of {G} is high. | The {G} office closed in 20{D}{D}. | By June {G} had passed {G} in {W}. | (Numbers for {G} are estimates.) | the {G} desk | The {G} region lags. | Compared with {G}, e.g. {N}.{D}% against {N}.{D}%.
{W1} {W} and {W} | {W1} of the {W} | {W1} by {W} | Notes for 20{D}{D} | {W1} {W1} Report | Annual Report 20{D}{D} | Quarterly Review | Executive Summary | Key Figures | Risk Update | Internal Audit | Board Meeting | Chief Executive Officer | The Board of Directors met. | Human Resources | {W1} in the {G} area
Invoice {N}{N} was cancelled on 20{D}{D}-0{D}-1{D}. | Order {N}{D}-0{D}{D}-{N} refers to lot 20{D}{D}-{D}{D}. | Voucher 00{N}{N} | quoted @ {D}.{N}% in draft {D}.{D}.{N} | moved from {D},{D}{D}{D},{D}{D}{D} to {D},{D}{D}{D},{D}{D}{D} units | Form {N} replaces draft {D}.{D}.{N}. | see p. {D} and Fig. {N} | {D} Jan. 20{D}{D} | US$ {D}.{D} bn | on day {D} at {D} p.m. | {D}{D}:{D}{D} | build {D}.{D}.{D}.{D} | {N}{N}{N}{N}{N}{N}{N} -0 1e{N} 0.000{N} | 100% | http://{w}.example/{w}?id={N} | <a href="{w}">{w}</a> &amp; {{{w}}} | ERROR {N}: {w}_{w} failed | SELECT {w}, {w} FROM {w} WHERE {w} = '20{D}{D}H{D}'; | | {w} | FY | HY | {N}.{D} | {N}.{D} |
However, the {W} fell. | When costs rise, the {W} falls. | If the {W} fades, the {W} may slip. | Since the {W} rose, nothing changed. | “The {W} is not good. We will work on it,” the team wrote. | Nothing suggests that the {W} of {G} will stop before Q{D}! | Is the {W} in {G} still weak? | Neither the {W} nor the {W} moved the {W} in {G}. | Management hopes the {W} stays near {N}.{D}%. | IFRS {D}, B2B {W} | CO2 per {W} fell in {G}, {W}. | The paper uses the word “{W1}” as it is. | In the U.S. market the {W} fell. | Approx. {N}.{D}% came from {W}, see Table No. {D}. | Some {D} in ten brokers | etc. The {W} rose.
""",
    "de": """
Die {f} AG kaufte die {f} GmbH. | Der Vertrag mit der {f} Rück SE in {G} lief aus. | Die {W1} in {G} stieg um {N},{D} %. | Der {W1} der {W1} wurde geprüft. | Ende 20{D}{D} lag die {W1} in {G} bei {N},{D} %. | Manche Orte, z. B. {G}, haben mehr {W1} als früher. | Nach dem {D}. Quartal sank die {W1} der {W1}. | Etwa {N},{D} % der {W1} entfallen auf die {W1}, siehe Tabelle Nr. {D}. | „Die {W1} reicht nicht“, sagt der Bericht der {W1}. | Wird die {W1} in {G} auch 20{D}{D} leiden? | Rechnung {N}{D}-0{D}{D}-{N} gehört zu {f}. | Vordruck Nr. {N} ersetzt Stand {D}.{D}.{N}. | Die {W1} hofft auf {N},{D} %; ihre {W1} blieb gleich. | {W1} und {W1} | Ausblick | Alle {W1} der {W1} fielen. | Im {W1} und am {W1} gab es {W1}. | Der Bau der {R} kostet {N} Mio.
""",
    "fr": """
La société {f} S.A. achète {f}. | L’accord pour {G} avec {f} Assurances a pris fin. | Le {w} de {G} monte de {N},{D} %. | La {w} baisse en 20{D}{D} par un {w} plus large. | Fin 20{D}{D}, la {w} valait {N},{D} % pour {G}. | « La {w} ne suffit pas », dit la note. | La {w} ({G}) sera-t-elle touchée par la {w} ? | Voir p. {D} pour la {w}. | Env. {N},{D} % vient du tableau no. {D}, avec la {w}. | La facture {N}{D}-0{D}{D}-{N} vise {f} Conseil. | Formulaire no. {N}, état {D}.{D}.{N}. | Les {w} suivent le {w} ; la {w} reste stable. | Résultats et {w} | Perspectives 20{D}{D}
""",
    "es": """
La firma {f} S.A. compró {f}. | El contrato en {G} con {f} Seguros terminó. | La {w} de {G} subió un {N},{D} %. | A fines de 20{D}{D} la {w} era del {N},{D} % en {G}. | «La {w} no basta», dice el informe. | ¿Bajará la {w} en {G}? | Cerca del {N},{D} % viene de la {w}, véase cuadro núm. {D}. | La factura {N}{D}-0{D}{D}-{N} es de {f} Consultores. | El {w} sube por la {w}; la {w} no cambia. | Resultados y {w} | La junta espera que la {w} siga cerca del {N},{D} % por {w}.
""",
    "pt": """
A empresa {f} S.A. comprou a {f}. | O contrato em {G} com a {f} Seguros acabou. | A {w} de {G} subiu {N},{D} %. | Ao fim de 20{D}{D} a {w} foi de {N},{D} % em {G}. | Cerca de {N},{D} % vem da {w}, ver quadro n.º {D}. | Os {w} caíram, mas a {w} não basta em {G}. | A direção espera que a {w} fique em {N},{D} %. | Vai a {w} cair em {G}?
""",
    "ru": """
Компания «{r}» купила «{r}». | К концу 20{D}{D} г. {r} в {G} достигла {N},{D} %. | Расходы упали на {D},{D} млн. руб. за год; {r} не изменилась. | «Пока {r} мала», — сказано в отчёте. | Вырастет ли {r} в {G}? | Причина — {r} и др., см. табл. {D}. | Ожидается, что {r} будет около {N},{D} %. | Итоги года
""",
    "zh": """
{K}公司收购了{K}集团。 | {K}的{K}上升{N}.{D}%。 | 20{D}{D}年{K}下降，原因是{K}。 | 报告指出：“{K}不足。” | {K}路项目第{N}期开工。 | {K}街债券已到期。 | 单据{N}{D}-0{D}{D}-{N}已作废。 | （{K}的数字未核实。） | 附注：{K}自20{D}{D}年起变更。 | 第{D}号表列出{K}；{K}未变。 | “{K}为何下降？”会议在20{D}{D}年问{K}。 | 如果{K}减弱，{K}会下降{N}.{D}点。 | 由于{K}，{K}会不会变差？ | {K}和{K}不一，FY20{D}{D}按{D}.{D}版重算。 | 这次，{K}让{K}回到{N}.{D}%！ | 预计{K}保持在{N}.{D}%，前提是{K}。 | 到20{D}{D}年底，{K}超过{K}。 | {K}展望 | 由{K}推动的{K}上升。 | {K}与{K}
""",
    "ja": """
{K}の{K}は{N}.{D}%上がった。 | 20{D}{D}年の{K}について。 | 「{K}は足りない。」と述べた。 | {K}を参照。 | {K}は今後どうなるか？ | {K}と{K}は{N}.{D}%で動くと見込む。 | 別紙{D}を見よ。
""",
    "th": "รายได้เพิ่มขึ้นร้อยละ {N}.{D} ในปี 20{D}{D} | ค่าใช้จ่ายลดลงเพราะความต้องการ | กำไรของสาขาสูงกว่าปีก่อน",
    "hi": "लागत {N}.{D}% बढ़ी और लाभ घटा। | वर्ष 20{D}{D} में आय बढ़ी। | तालिका {D} देखें।",
}

# Common names of many countries.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Emma Olivia Noah Liam Lukas Felix Moritz Katharina Sabine Ursula Wolfgang Jürgen Günther
Pierre Jacques Camille Chloé Élodie François Hélène Juan Carlos Lucía Sofía Javier Begoña João Inês Tiago Beatriz Ivan Olga Dmitri Svetlana Hiroshi Yuki Kenji Sakura Wei Ming Jing Raj Priya Arjun Ananya Somchai Kwame Amina Chinedu Fatima Omar Layla Yusuf Giulia Marco Sven Astrid Lars""".split()
FAMILY = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Clark Lewis Walker Hall Young Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Dubois Moreau Laurent Bernard Girard
Rodríguez Fernández González López Martínez Pereira Oliveira Costa Almeida Ivanov Petrov Smirnov Tanaka Suzuki Watanabe Yamamoto Chen Wang Zhang Huang Sharma Patel Gupta Mensah Adeyemi Rossi Bianchi Nielsen Johansson O’Brien O'Connor McDonald Saint-Clair Smith-Jones García-Vega""".split()
CYRILLIC = ["Иван", "Ольга", "Дмитрий", "Светлана", "Сергей", "Мария"], ["Иванов", "Петрова", "Смирнов", "Кузнецов", "Попова"]
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷黎史龙陶贺顾毛郝龚邵万钱严覃武戚莫孔向汤云冉厉左简鹿沐欧卓岑柳"
GIVEN_HAN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉萍红鹏辉建国志文海波春生晓雪梅子轩雨涵欣怡浩然一诺思远博若清晨月光安宁嘉祺书瑶知行望山川舟禾青云岚溪"
JAPANESE = ["佐藤", "鈴木", "高橋", "田中", "渡辺", "伊藤", "山本", "中村"], ["太郎", "花子", "健一", "美咲", "翔", "由美"]
PLACES = "London Paris Berlin Madrid Lisbon Moscow Tokyo Osaka Beijing Shanghai Shenzhen Bangkok Delhi Mumbai Singapore Malaysia Indonesia Thailand Vietnam Japan China India Macau Taiwan Korea Germany France Spain Portugal Brazil Mexico Canada Australia Africa Asia Europe Hongkong Singapour Malasia Malaisie Vietnã Vietnam Singapur".split()
PLACES2 = ["Hong Kong", "New York", "New Zealand", "South Africa", "Sri Lanka", "Costa Rica", "San Francisco", "Los Angeles", "Kuala Lumpur", "Cape Town", "Middle East", "North America", "Saudi Arabia", "Buenos Aires"]
STREET_EN = "Street St St. Road Rd Rd. Lane Ln Avenue Ave Ave. Drive Close Court Way Square Terrace Place Boulevard".split()
STREET_DE = ["straße", "strasse", "weg", "gasse", "allee", "platz", "ring"]
ROAD_FR = ["rue", "avenue", "quai", "boulevard", "place", "chemin", "allée", "impasse", "cours"]
ROAD_ES = ["Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Rúa"]
AREA_HAN = "东西南北中新长安平和人民解放建设文化光明青年春江河湖山海金银铜石木花园林桥塘沙湾溪口田里"
WORDS_HAN = "利率收入保费成本费用市场需求资本盈余风险价值业务增长分红投资准备金渠道客户产品团队计划管理董事会公司再保险赔款审批代理网点口径报告部门地区全球内地海外亚太东部西部"


class Fillers:
    """Random fillers of the slots, the same for the same seed. ``given`` and ``family`` may be other names."""

    def __init__(self, seed: int = 7, given: list[str] | None = None, family: list[str] | None = None):
        self.r = random.Random(seed)
        self.given_names, self.family_names = given or GIVEN, family or FAMILY

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def coin(self, p: float = 0.5) -> bool:
        return self.r.random() < p

    def pick(self, x):
        return self.r.choice(x)

    def word(self, least: int = 2, most: int = 4) -> str:
        onset = ["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "w", "x", "y", "z", "br", "cr", "dr", "fl", "gr", "st", "tr", "th", "ch", "sch", "sh", "pl", "kr", "tch", ""]
        nucleus = "aaeeiiouyäéöüáíóñ" if self.coin(0.1) else "aeiouaeiouy"
        coda = ["", "", "", "n", "r", "l", "s", "t", "m", "ck", "rn", "lt", "nd", "x", "ng", "lv", "rr", "sk", "th"]
        return "".join(self.pick(onset) + self.pick(nucleus) + self.pick(coda) for _ in range(self.r.randint(least, most))) + (self.pick(["e", "a", "o", "y", "ia", "es", "er"]) if self.coin(0.3) else "")

    def cap(self, least: int = 2, most: int = 3) -> str:
        return self.word(least, most).capitalize()

    def given(self) -> str:
        x = self.pick(self.given_names) if self.coin(0.35) else self.cap(1, 3)
        x = x if len(x) > 2 else self.cap(2, 2)
        return x + self.pick(["-", " "]) + self.cap(2, 2) if self.coin(0.04) else x

    def family(self) -> str:
        x = self.pick(self.family_names) if self.coin(0.35) else self.cap(2, 3)
        kind = self.r.random()
        if kind < 0.05:
            x = self.pick(["O’", "O'", "D’", "Mc"]) + x
        elif kind < 0.12:
            x += "-" + self.cap(2, 3)
        elif kind < 0.24:
            x = self.pick(["de ", "de la ", "von ", "van der ", "du ", "della ", "dos ", "da ", "le ", "al-"]) + x
        return x

    def person(self) -> str:
        f, l, i = self.given(), self.family(), self.pick("ABCDEFGHIJKLMNOPRSTUVWZ") + "."
        form = self.r.random()
        s = f"{f} {l}" if form < 0.5 else f"{f} {i} {l}" if form < 0.64 else f"{i} {l}" if form < 0.78 else f"{l}, {f}" if form < 0.95 else f"{i} {self.pick('ABCDEFG')}. {l}"
        return s.upper() if self.coin(0.15) else s

    def cyrillic(self) -> str:
        return f"{self.pick(CYRILLIC[0])} {self.pick(CYRILLIC[1])}"

    def host(self) -> str:
        return ".".join(x.encode("ascii", "ignore").decode() for x in [self.word(1, 3).lower() + self.pick(["", "", "-" + self.word(1, 2)]), *([self.word(1, 2)] if self.coin(0.3) else []), self.pick(["com", "org", "net", "de", "fr", "co.uk", "cn", "example", "test", "invalid", "info", "biz"])])

    def email(self) -> str:
        ascii_only = lambda x: "".join(c for c in x.lower().replace(" ", ".") if c.isascii() and (c.isalnum() or c == "."))
        f, l = ascii_only(self.given()) or "ana", ascii_only(self.family()) or "lee"
        local = self.pick([f, f[0], l]) + self.pick([".", "_", "-", ""]) + l + (self.digits(self.r.randint(1, 3)) if self.coin(0.3) else "") + ("+" + self.word(1, 2) if self.coin(0.12) else "")
        host, form = self.host(), self.r.random()
        if form < 0.18:
            if self.coin(0.7):
                host = host.replace(".", self.pick([" [dot] ", " (dot) ", " dot ", "[dot]", "(dot)"]))
                s = local + self.pick([" AT ", " (at) ", " [at] ", "[at]", "(at)", " at "]) + host
            else:
                s = local + self.pick([" AT ", " (at) ", " [at] ", "(at)"]) + host
        else:
            s = f"{local} @ {host}" if form < 0.3 else f"{local}@{host}"
        return s.upper() if form > 0.3 and self.coin(0.12) else s

    def phone(self) -> str:
        """National and international forms by country: groups of digits, signs between them, trunk prefixes in brackets."""
        d, sep = self.digits, self.pick([" ", " ", "-", ".", " "])
        kind = self.r.random()
        groups = lambda *n: sep.join(d(k) for k in n)
        country = "+" + self.pick(["1", "7", "33", "34", "39", "44", "49", "55", "61", "65", "81", "86", "91", "351", "852", "853", "66"])
        shape = self.pick([(3, 4), (4, 4), (3, 3, 4), (2, 4, 4), (2, 2, 2, 2), (1, 2, 2, 2, 2), (3, 3, 3), (4, 6), (5, 6), (3, 2, 2), (2, 5, 4), (5, 3), (10,), (8,)])
        if kind < 0.34:
            return f"{country}{self.pick([' ', '-', ' '])}{groups(*shape)}"
        if kind < 0.42:
            return f"{country} ({d(self.r.randint(1, 3))}) {groups(*shape[:3])}"
        if kind < 0.52:
            return f"({d(self.r.randint(2, 4))}){self.pick([' ', '', '-'])}{groups(*self.pick([(4, 4), (3, 4), (6,), (7,)]))}"
        if kind < 0.57:
            return f"（{d(self.r.randint(2, 4))}）{d(4)}-{d(4)}"
        if kind < 0.63:
            return f"00{country[1:]} {self.pick(['(0)', ''])}{groups(*self.pick([(2, 4, 4), (3, 7), (2, 8)]))}".replace("  ", " ")
        if kind < 0.72:
            return f"0{d(self.r.randint(2, 4))}{self.pick(['/', '-', ' '])}{d(self.r.randint(4, 5))}{self.pick(['-', '', ' '])}{d(3)}"
        if kind < 0.8:
            return f"0{d(self.r.choice([1, 2, 3, 4]))}{sep}{groups(*self.pick([(3, 4), (4, 4), (2, 2, 2), (6,), (3, 3), (2, 2, 2, 2)]))}"
        return groups(*self.pick([(3, 4), (3, 3, 4), (4, 4), (3, 4), (3, 4)])).replace(" ", "-" if self.coin() else ".") if kind < 0.95 else "1" + d(10)

    def number(self) -> str:
        """Social security, insurance, passport and identity card numbers by their public forms."""
        d, u = self.digits, lambda n: "".join(self.pick("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        sep = self.pick(["-", " "])
        return self.pick(
            [f"{d(3)}{sep}{d(2)}{sep}{d(4)}", f"{u(2)}{d(6)}{self.pick('ABCD')}", f"{u(2)} {d(2)} {d(2)} {d(2)} {self.pick('ABCD')}", f"{u(1)}{d(8)}", f"{u(1)}{d(9)}", f"{u(2)}{d(7)}", f"{u(1)}{d(6)}({self.pick('0123456789A')})", f"{u(2)}{d(6)}({self.pick('0123456789A')})", f"{d(8)}{self.pick(['-', ''])}{u(1)}"]
            + [f"{d(6)}{self.pick(['19', '20'])}{d(2)}{self.pick(['01', '02', '05', '09', '10', '12'])}{d(2)}{d(3)}{self.pick('0123456789X')}"] * 2
        )

    def address(self) -> str:
        n = str(self.r.randint(1, 250)) + (self.pick("ABab") if self.coin(0.05) else "")
        town = self.cap(2, 3) if self.coin(0.65) else self.pick(["Port ", "St. ", "San ", "New ", "Bad ", "Puerto ", "Villa ", "Santa ", "Saint ", "Upper "]) + self.cap(2, 2)
        code = self.digits(5)
        kind = self.r.random()
        if kind < 0.5:
            road = self.cap(2, 3) + (" " + self.cap(1, 2) if self.coin(0.2) else "")
            street = f"{n} {road} {self.pick(STREET_EN)}"
            if self.coin(0.4):
                street += ", " + self.pick([f"Flat {self.r.randint(1, 40)}", f"Unit {self.r.randint(1, 9)}{self.pick('ABCD')}", f"Apt {self.r.randint(1, 40)}", f"Floor {self.r.randint(2, 20)}", f"Suite {self.digits(3)}"])
            last = self.pick(["", "", " " + code, f" {self.pick('ABCDEFGHLMNSWZ')}{self.pick('ABCDEGHLMNRZ')}{self.r.randint(1, 20)} {self.digits(1)}{self.pick('ABDEQ')}{self.pick('ABDEQ')}", f", {self.pick(['NY', 'CA', 'TX'])} {code}"])
            return street + self.pick([", ", ", ", ", ", "\n"]) + town + last
        if kind < 0.68:
            street = self.pick([self.cap(2, 3) + self.pick(STREET_DE), self.cap(2, 3) + self.pick(STREET_DE), self.pick(["Am ", "An der ", "Im ", "Am "]) + self.cap(2, 2), self.cap(2, 2) + " " + self.pick(["Straße", "Weg", "Platz"])])
            return f"{street} {n}, {code} {town}"
        if kind < 0.86:
            name = self.pick(["", "de ", "du ", "des ", "de la ", "de l’"]) + self.cap(2, 3) + self.pick(["", "", " " + self.cap(1, 2), "-" + self.cap(1, 2)])
            return f"{n}{self.pick(['', '', '', ' bis', ' ter'])}, {self.pick(ROAD_FR)} {name}, {code} {town.replace(' ', '-') if self.coin() else town}"
        return f"{self.pick(ROAD_ES)} {self.pick(['', 'de ', 'del ', 'de la '])}{self.cap(2, 3)}{self.pick(['', ' ' + self.cap(2, 2)])}, {n}, {code} {town}"

    def han(self) -> str:
        return self.pick(SURNAMES) + "".join(self.pick(GIVEN_HAN) for _ in range(self.pick([1, 2, 2, 2])))

    def han_place(self, n: int) -> str:
        return "".join(self.pick(AREA_HAN) for _ in range(n))

    def street(self) -> str:
        n = self.r.randint(1, 250)
        area = self.pick([self.han_place(2) + "市" + self.han_place(2) + "区", self.han_place(2) + "区", self.han_place(2) + "市", self.pick(["北京市", "上海市", "广州市", "香港", "九龙", "台北市"]), ""])
        road = self.han_place(2) + self.pick(["路", "路", "街", "大道", "里", "巷"])
        return area + road + f"{n}号" + self.pick(["", "", f"{self.r.randint(2, 30)}楼", f"{self.pick('ABCD')}座{self.r.randint(1, 300)}室", f"{self.r.randint(1, 30)}层", f"{self.r.randint(1, 20)}栋{self.digits(3)}室"])

    def place(self) -> str:
        kind = self.r.random()
        if kind < 0.3:
            return self.pick(PLACES)
        if kind < 0.55:
            return self.pick(PLACES2)
        if kind < 0.85:
            return self.pick(["St. ", "Port ", "Mt. ", "Mount ", "Lake ", "San ", "New ", "Fort ", "Cape "]) + self.cap(2, 3)
        return self.cap(2, 3)

    def firm(self) -> str:
        return self.cap(2, 3) + " " + self.pick(["Holdings", "Holdings Inc.", "Group", "Ltd.", "Inc.", "plc", "AG", "GmbH", "S.A.", "Partners", "& Co.", "Capital", "Insurance", "Reinsurance Ltd.", "Bank", "Life", "Re"])

    def words_han(self) -> str:
        i = self.r.randrange(0, len(WORDS_HAN) - 6)
        return WORDS_HAN[i : i + self.r.randint(2, 5)]

    def fill(self, template: str, language: str = "en") -> tuple[str, list[tuple[int, int, str]]]:
        """Text and its spans (start, end, kind)."""
        labelled = {"P": ("person", self.cyrillic if language == "ru" and self.coin(0.6) else self.person), "L": ("person", self.family), "H": ("person", (lambda: self.pick(JAPANESE[0]) + self.pick(JAPANESE[1])) if language == "ja" else self.han), "E": ("email", self.email), "T": ("phone", self.phone), "I": ("id_number", self.number), "A": ("address", self.address), "C": ("address", self.street)}
        open_ = {"O": lambda: self.pick(ROLES.get(language, ROLES["en"]).split("|")), "V": lambda: self.pick(PAPERS.get(language, PAPERS["en"]).split("|")), "Z": lambda: self.pick(LANDS_HAN), "N4": lambda: self.digits(self.pick([3, 4, 4, 5])), "U": lambda: self.pick("ABCDEFGHKLMNPRSTUVWXYZ"), "N": lambda: self.digits(self.r.randint(1, 4)), "D": lambda: self.digits(1), "W": lambda: " ".join(self.word() for _ in range(self.r.randint(1, 2))), "w": self.word, "W1": self.cap, "f": self.cap, "F": self.firm, "G": self.place, "K": self.words_han, "r": lambda: "".join(self.pick("бвгдклмнпрст") + self.pick("аеиоу") for _ in range(3)), "R": lambda: f"{self.cap(2, 3)} {self.pick(STREET_EN)}" if language != "de" else self.cap(2, 3) + self.pick(STREET_DE)}
        out, spans, at = "", [], 0
        while (i := template.find("{", at)) >= 0:
            j = template.find("}", i)
            slot = template[i + 1 : j] if j > 0 else ""
            out += template[at:i]
            if slot in labelled:
                kind, make = labelled[slot]
                s = make()
                spans.append((len(out), len(out) + len(s), kind))
            elif slot in open_:
                s = open_[slot]()
            else:
                out += "{"
                at = i + 1
                continue
            out += s
            at = j + 1
        return out + template[at:], spans


def _split(frames: dict[str, str]) -> list[tuple[str, str]]:
    return [(lang, t.strip().replace("\\n", "\n")) for lang, block in frames.items() for line in block.strip().split("\n") for t in line.split(" | ") if t.strip()]


def labelled(n: int = 5000, seed: int = 7, fillers: Fillers | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n short documents of labelled sentences; every frame is used about equally often."""
    f = fillers or Fillers(seed)
    every = list(FRAMES)
    common = lambda extra: {lang: extra.get("", "").strip() + "\n" + extra.get(lang, "") for lang in every}
    some, none = _split(FRAMES) + _split(common(ROLE_FRAMES)), _split(PLAIN) + _split(common(PAPER_FRAMES))
    by: dict[bool, dict[str, list[str]]] = {True: {}, False: {}}
    for k, rows in ((True, some), (False, none)):
        for lang, t in rows:
            by[k].setdefault(lang, []).append(t)
    out = []
    for k in range(n):
        text, spans = "", []
        lang = some[k % len(some)][0] if f.coin(0.6) else f.pick(list(FRAMES))
        for j in range(f.r.randint(2, 5)):
            t = some[k % len(some)][1] if j == 0 and lang == some[k % len(some)][0] else f.pick(by[f.coin(0.5)][lang])
            s, own = f.fill(t, lang)
            gap = f.pick([" ", " ", " ", "\n", "\n\n", ""]) if text else ""
            if gap == "" and text and text[-1] not in "。！？":
                gap = " "
            spans += [(a + len(text) + len(gap), b + len(text) + len(gap), c) for a, b, c in own]
            text += gap + s
        out.append((text, spans))
    return out
