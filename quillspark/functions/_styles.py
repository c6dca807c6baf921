"""Facts of the USFM 3 default style sheet, one line a marker: style type, text type,
property bits (hex), nesting, number of the set of parents, attributes.

Compiled from the stylesheet published for USFM, which is under CC BY 4.0 (see NOTICE).
A parent set is a bit mask (hex) over the markers in the order of the lines.
"""

STYLES = """
add:Cv90+18:
addpn:Cv90+19:
b:Pv298-12:
bd:Co90+21:
bdit:Co90+21:
bk:Cv90+22:
c:Pc20-39:
ca:Co0-5:
cat:Cf490-0:
cd:Po98-5:
cl:Po8-15:
cls:Pv98-5:
conc:Pv298-39:
cov:Pv298-39:
cp:Po8-5:
d:Pv99-5:
dc:Cv90+24:
ef:Nf490-7:
efe:Nf490-7:
em:Co90+21:
erq:Po490-13:
erqe:Po490-9:
esb:Po490-13:
esbe:Po490-11:
ex:Nf490-7:
f:Nf490-6:
fdc:Cf490-31:
fe:Nf490-8:
fig:Co98+23:src size ref ?alt ?loc ?copy
fk:Cf490-31:
fl:Cf490-31:
flag:Co0+0:
fm:Co98-28:
fp:Cf490-31:
fq:Cf490-31:
fqa:Cf490-31:
fr:Cf490-31:
fs:Cf490-31:
ft:Cf490-31:
fv:Cf490+31:
fw:Cf490-35:
glo:Pv298-39:
h:Po98-39:
h1:Po98-39:
h2:Po98-39:
h3:Po98-39:
ib:Po298-39:
id:Po108-0:
ide:Po8-39:
idx:Pv298-39:
ie:Po98-39:
iex:Po98-39:
ili:Po99-39:
ili1:Po99-39:
ili2:Po9a-39:
im:Po98-39:
imi:Po98-39:
imq:Po98-39:
imt:Po99-39:
imt1:Po99-39:
imt2:Po9a-39:
imt3:Po9b-39:
imt4:Po9c-39:
imte:Po99-39:
imte1:Po99-39:
imte2:Po9a-39:
intro:Pv298-39:
io:Po99-39:
io1:Po99-39:
io2:Po9a-39:
io3:Po9b-39:
io4:Po9c-39:
ior:Co90+41:
iot:Po98-39:
ip:Po98-13:
ipc:Po98-39:
ipi:Po98-39:
ipq:Po98-39:
ipr:Po98-39:
iq:Po299-39:
iq1:Po299-39:
iq2:Po29a-39:
iq3:Po29b-39:
iqt:Co90-38:
is:Po99-39:
is1:Po99-39:
is2:Po9a-39:
it:Co90+21:
jmp:Co0+21:?link-href ?link-id ?link-title
k:Cv90+23:
k1:Po98-39:
k2:Po98-39:
lf:Pv98-12:
lh:Pv98-12:
li:Pv99-12:
li1:Pv99-12:
li2:Pv9a-12:
li3:Pv9b-12:
li4:Pv9c-12:
lik:Cv90+43:
lim:Pv99-5:
lim1:Pv99-5:
lim2:Pv9a-5:
lim3:Pv9b-5:
lim4:Pv9c-5:
lit:Po98-5:
litl:Cv90+43:
liv:Cv90+43:
liv1:Cv90+43:
liv2:Cv90+43:
liv3:Cv90+43:
liv4:Cv90+43:
liv5:Cv90+43:
m:Pv98-12:
maps:Pv298-39:
mi:Pv98-12:
mr:Ps99-44:
ms:Ps99-10:
ms1:Ps99-5:
ms2:Ps99-5:
ms2e:Ps99-5:
ms3:Ps99-5:
ms3e:Ps99-5:
mse:Ps99-5:
mt:Pt99-39:
mt1:Pt99-39:
mt2:Pt9a-39:
mt3:Pt9b-39:
mt4:Pt9c-39:
mte:Pt99-5:
mte1:Pt99-30:
mte2:Pt9a-45:
nb:Pv98-5:
nd:Cv90+24:
ndx:Cv90+20:
no:Co90+17:
ord:Cv90+23:
p:Pv98-12:
p1:Po98-39:
p2:Po98-39:
pb:Po10-5:
pc:Pv98-12:
periph:Ps88-0:
ph:Pv98-5:
ph1:Pv98-5:
ph2:Pv98-5:
ph3:Pv98-5:
phi:Pv98-5:
pi:Pv99-12:
pi1:Pv99-12:
pi2:Pv9a-12:
pi3:Pv9b-12:
pm:Pv98-2:
pmc:Pv98-3:
pmo:Pv98-3:
pmr:Pv98-1:
pn:Cv90+19:
png:Cv90+19:
po:Pv98-5:
pr:Pv98-5:
pref:Pv298-39:
pro:Co0+26:
ps:Pv98-5:
psi:Pv98-5:
pub:Pv298-39:
pubinfo:Po8-40:
q:Pv299-5:
q1:Pv299-5:
q2:Pv29a-5:
q3:Pv29b-5:
q4:Pv29c-5:
qa:Po298-12:
qac:Co290+48:
qc:Pv298-12:
qd:Pv298-5:
qm:Pv298-4:
qm1:Pv299-4:
qm2:Pv29a-4:
qm3:Pv29b-4:
qr:Pv298-12:
qs:Cv290+47:
qt:Cv90+24:
qt-e:Mo0-39:?who ?sid ?eid
qt-s:Mo0-39:?who ?sid ?eid
qt1-e:Mo0-39:?who ?sid ?eid
qt1-s:Mo0-39:?who ?sid ?eid
qt2-e:Mo0-39:?who ?sid ?eid
qt2-s:Mo0-39:?who ?sid ?eid
qt3-e:Mo0-39:?who ?sid ?eid
qt3-s:Mo0-39:?who ?sid ?eid
qt4-e:Mo0-39:?who ?sid ?eid
qt4-s:Mo0-39:?who ?sid ?eid
qt5-e:Mo0-39:?who ?sid ?eid
qt5-s:Mo0-39:?who ?sid ?eid
r:Ps99-16:
rb:Cv90+26:gloss
ref:Cf490+0:
rem:Po8-14:
restore:Po8-39:
rq:Co90+42:
s:Ps99-5:
s1:Ps99-5:
s1e:Ps99-5:
s2:Ps9a-5:
s2e:Ps9a-5:
s3:Ps9b-5:
s3e:Ps9b-5:
s4:Ps9c-5:
s4e:Ps9c-5:
s5:Ps9d-5:
sc:Co90+21:
sd:Ps99-5:
sd1:Ps99-5:
sd2:Ps9a-5:
sd3:Ps9b-5:
sd4:Ps9c-5:
sig:Cv90+19:
sls:Cv90+33:
sp:Ps99-5:
spine:Pv298-39:
sr:Ps99-49:
sts:Po8-14:
sup:Co90+21:
ta:Cv90+19:
tc1:Cv90-50:
tc10:Cv90-50:
tc11:Cv90-50:
tc12:Cv90-50:
tc2:Cv90-50:
tc3:Cv90-50:
tc4:Cv90-50:
tc5:Cv90-50:
tc6:Cv90-50:
tc7:Cv90-50:
tc8:Cv90-50:
tc9:Cv90-50:
tcc1:Cv90-50:
tcc10:Cv90-50:
tcc11:Cv90-50:
tcc12:Cv90-50:
tcc2:Cv90-50:
tcc3:Cv90-50:
tcc4:Cv90-50:
tcc5:Cv90-50:
tcc6:Cv90-50:
tcc7:Cv90-50:
tcc8:Cv90-50:
tcc9:Cv90-50:
tcr1:Cv90-50:
tcr10:Cv90-50:
tcr11:Cv90-50:
tcr12:Cv90-50:
tcr2:Cv90-50:
tcr3:Cv90-50:
tcr4:Cv90-50:
tcr5:Cv90-50:
tcr6:Cv90-50:
tcr7:Cv90-50:
tcr8:Cv90-50:
tcr9:Cv90-50:
th1:Cv90-50:
th10:Cv90-50:
th11:Cv90-50:
th12:Cv90-50:
th2:Cv90-50:
th3:Cv90-50:
th4:Cv90-50:
th5:Cv90-50:
th6:Cv90-50:
th7:Cv90-50:
th8:Cv90-50:
th9:Cv90-50:
thc1:Cv90-50:
thc10:Cv90-50:
thc11:Cv90-50:
thc12:Cv90-50:
thc2:Cv90-50:
thc3:Cv90-50:
thc4:Cv90-50:
thc5:Cv90-50:
thc6:Cv90-50:
thc7:Cv90-50:
thc8:Cv90-50:
thc9:Cv90-50:
thr1:Cv90-50:
thr10:Cv90-50:
thr11:Cv90-50:
thr12:Cv90-50:
thr2:Cv90-50:
thr3:Cv90-50:
thr4:Cv90-50:
thr5:Cv90-50:
thr6:Cv90-50:
thr7:Cv90-50:
thr8:Cv90-50:
thr9:Cv90-50:
tl:Cv10+19:
toc:Pv298-39:
toc1:Po98-37:
toc2:Po98-37:
toc3:Po98-37:
toca1:Po98-36:
toca2:Po98-36:
toca3:Po98-36:
tr:Pv98-12:
tr1:Pv98-5:
tr2:Pv98-5:
ts-e:Mo0-39:?sid ?eid
ts-s:Mo0-39:?sid ?eid
usfm:Po8-39:
v:Cn40-29:
va:Co0-29:
vp:Co0-25:
w:Cv90+20:?lemma ?strong ?srcloc
wa:Cv90+20:
wg:Cv90+20:
wh:Cv90+20:
wj:Cv90+24:
wl:Cv90+19:
wr:Cv90+32:
x:Nfc90-27:
xdc:Cf490-34:
xk:Cf490-34:
xnt:Cf490-34:
xo:Cf490-34:
xop:Cf490-51:
xot:Cf490-34:
xq:Cf490-34:
xt:Cf490+21:?link-href
xtSee:Cf90-46:
xtSeeAlso:Co90-46:
xta:Cf490-34:
zpa-d:Co98-39:
zpa-xb:Co98-39:
zpa-xc:Co98-39:
zpa-xv:Co98-39:
"""

PARENTS = """
0
aa00000827c0c0f8a210000a01f7c00000000000000000000004
aa00000827c8c0f8a210000a0000000000000000000000000004
aa00000827c0c0f8a210000a0000000000000000000000000004
827c080f8a210000a0000000000000000000000000004
40
7104002b00001fe7c0cff8a210f2ea01f7f077fefbfff800000000c040
7104002b00001fa7c0cff8a210f2ea01f7f077fefbfff800000000c040
7104002b00000fe7c0cff8a21002ea01f7f077fefbfff8000000008040
800000100040
400040
800000400040
ab00000000000000000000e00000000004000000000000400040
800000000040
1800000000040
2f00000000000000000800000000040
ab00000000000000000000000000000000000000000000000040
1000710000710710000710400ab00000fe7c0cff8a21000ea01f7f017f6f803f800000a068a00
1000710000710710000710400ab00000fe7c0cff8a21000ea01f7f007f4f803f000000a068a00
1000710000710710000710400ab00000fe7c0cff8a21000ea01f7f007f4f8038000000a068a00
10001000710000710710000710400ab00000fe7c0cff8a21000ea01f7f007f4f803f000000b568200
10001000710000710710000710400ab00000fe7c0cff8a21000ea01f7f007f4f803f000000b068200
1000710000710710000710400ab00000fe7c0cff8a21000ea01f7f077f4fbfff000000a068200
1000710000710710000710400ab00000fe7c0cff8a21000ea01f7f007f4f803f000000a068200
1000710000710710000710400ab00000fe7c0cff8a21000ea01f7f007f4f8038000000a068200
10000000000007100007104002000000fe7c0cff8a210000a01f7f00000000000000000008200
10007100007107100007104002b00000fe7c0cff8a21000ea01f7f007f4f803f000000a068000
7104002b00001fe7c0cff8a210f0ea01f7f077fefbfff8000000008000
7104002b00000fe7c0cff8a21000ea01f7f00004000000000000008000
10000000000007100007104002000000fe7c0cff8a210000a01f7f00000000000000000008000
7100002000000fe7c0cff8a210000a01f7f00000000000000000008000
a060000
7100000100000867c0c0f8a210002a01f7f0000000000000000a060000
10007100007107100007104000000000fe7c0cff8a210000a01f7f0000000000000000a060000
100000000000000000000000000000000000000000000000000000000000000000000000001000000
a000000
3c0000000000
bc0000000000
77f6fbfffc400000000000
800000000000
1800000000000
f80000800000000000
fe7c0cff8a210000a01f7f00000000000000000000000
1f7c00000000000000000000000
2e00000000000000000000000000000
400000000000000000000000000000000
20000000000000000000000000000000000
867c00000000000000000000000000000000000000000
827c00000000000000000000000000000000000000000
ab00000000000000000000000000000000000000000000000000
10000000000000000000000000000000000000000000000000000000000000000000000000000
100000000000000000000000000000000000000000000000000000000000000000000000000000000
"""
