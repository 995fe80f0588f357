"""An example for every checker: sources that it reports, with the rows (from 0) of its issues, and one that it leaves alone."""

from __future__ import annotations

#: id -> (language, reported source, rows, clean source)
EXAMPLES: dict[str, tuple[str, str, list[int], str]] = {}


def _add(lang: str, **of: tuple[str, list[int], str]) -> None:
    for name, (bad, rows, good) in of.items():
        EXAMPLES[name.replace("__", "-")] = (lang, bad, rows, good)


_add(
    "dockerfile",
    avoid_add=("FROM alpine:3.20\nADD a.txt /a\n", [1], "FROM alpine:3.20\nCOPY a.txt /a\n"),
    avoid_latest=("# base\nFROM alpine:latest AS base\nRUN ls\n", [1], "FROM alpine:3.20\n"),
    avoid_sudo=("FROM alpine\nRUN sudo ls \\\n  -l\n", [1], "FROM alpine\nRUN ls sudo\n"),
)
_add(
    "go",
    go_cgi_import=('package a\nimport "net/http/cgi"\n', [1], 'package a\nimport "net/http"\n'),
    go_math_rand=('package a\nimport (\n\tr "math/rand"\n)\n', [2], 'package a\nimport "crypto/rand"\n'),
    go_md5_weak_hash=('package a\nimport (\n\t"fmt"\n\t"crypto/md5"\n)\n', [3], 'package a\nimport "crypto/sha256"\n'),
    go_reflect_pkg=('import "reflect"\n', [0], 'import "reflection"\n'),
    go_unsafe_pkg=('import "unsafe"\n', [0], 'import "safe"\n'),
    go_pprof_endpoint_automatic_exposure=('import _ "net/http/pprof"\n', [0], 'import p "net/http/pprof"\n'),
    go_des_weak_crypto=("func f() {\n\tc, err := des.NewCipher(k)\n}\n", [1], "func f() {\n\tc, err := aes.NewCipher(k)\n}\n"),
    go_fmt_print_in_prod=('func f() {\n\tfmt.Println("x")\n\tfmt.Printf("%d", 1)\n}\n', [1, 2], "func f() {\n\tlog.Println(1)\n\tfmt.Sprint(2)\n}\n"),
    go_grpc_client_insecure_tls=("func f() {\n\tc, err := grpc.Dial(a, grpc.WithInsecure())\n}\n", [1], "func f() {\n\tc, err := grpc.Dial(a, creds)\n}\n"),
    go_grpc_server_insecure_tls=("func f() {\n\ts := grpc.NewServer()\n}\n", [1], "func f() {\n\ts := grpc.NewServer(grpc.Creds(c))\n}\n"),
    go_http_file_server=('func f() {\n\thttp.Handle("/", http.FileServer(http.Dir(".")))\n}\n', [1], "func f() {\n\thttp.Handle(p, http.FileServer(fs))\n}\n"),
    go_insecure_cookie=('func f() {\n\thttp.SetCookie(w, &http.Cookie{Name: "s", Secure: false})\n}\n', [1], 'func f() {\n\thttp.SetCookie(w, &http.Cookie{Name: "s", Secure: true})\n}\n'),
    go_samesite_cookie=('func f() {\n\thttp.SetCookie(w, &http.Cookie{Name: "s"})\n}\n', [1], "func f() {\n\thttp.SetCookie(w, &http.Cookie{SameSite: http.SameSiteLaxMode})\n}\n"),
    go_jwt_harcoded_signing_key=('func f() {\n\treturn t.SignedString([]byte("k"))\n}\n', [1], "func f() {\n\treturn t.SignedString(key)\n}\n"),
    go_jwt_none_algorithm=("func f() {\n\tt := jwt.New(jwt.SigningMethodNone)\n}\n", [1], "func f() {\n\tt := jwt.New(jwt.SigningMethodHS256)\n}\n"),
    go_missing_error_file_open=("func f() {\n\tx, _ := os.Open(p)\n}\n", [1], "func f() {\n\tx, err := os.Open(p)\n}\n"),
    go_os_create_file_default_permission=("func f() {\n\tx, err := os.Create(p)\n}\n", [1], "func f() {\n\tx, err := os.OpenFile(p, m, 0600)\n}\n"),
    go_mysql_conn_raw_passwd=('func f() {\n\tsql.Open("mysql", "u:p@tcp(h)/d")\n}\n', [1], 'func f() {\n\tsql.Open("mysql", dsn)\n}\n'),
    go_postgres_conn_raw_passwd=('func f() {\n\tsql.Open("postgres", "postgres://u:p@h/d")\n}\n', [1], 'func f() {\n\tsql.Open("postgres", "host=h")\n}\n'),
    go_postgres_config_raw_passwd=('var o = &pg.Options{User: "u", Password: "p"}\n', [0], 'var o = &pg.Options{Password: os.Getenv("P")}\n'),
    go_net_bind_all_interfaces=('func f() {\n\tl, e := net.Listen("tcp", ":80")\n}\n', [1], 'func f() {\n\tl, e := net.Listen("tcp", "127.0.0.1:80")\n}\n'),
    go_tls_config_minver=('func f() {\n\tc := &tls.Config{ServerName: "x"}\n}\n', [1], "func f() {\n\tc := &tls.Config{MinVersion: tls.VersionTLS13}\n}\n"),
    go_tls_insecure=("func f() {\n\tc := &tls.Config{InsecureSkipVerify: true}\n}\n", [1], "func f() {\n\tc := &tls.Config{InsecureSkipVerify: false}\n}\n"),
    go_sha1_weak_hash=("func f() {\n\th := sha1.New()\n\tprep()\n\th.Write(b)\n\ts := h.Sum(nil)\n}\n", [1], "func f() {\n\th := sha256.New()\n\th.Write(b)\n\ts := h.Sum(nil)\n}\n"),
    html_req_template_injection=('func f() {\n\tin := r.FormValue("n")\n\tdata := map[string]string{"N": in}\n\terr = t.Execute(w, data)\n}\n', [1], 'func f() {\n\tin := r.FormValue("n")\n\tdata := map[string]string{"N": clean}\n\terr = t.Execute(w, data)\n}\n'),
)
_J = "class A {{\n  void f() {{\n    {};\n  }}\n}}\n"
_add(
    "java",
    cbc__padding__oracle=(_J.format('Cipher c = Cipher.getInstance("AES/CBC/PKCS5Padding")'), [2], _J.format('Cipher c = Cipher.getInstance("AES/GCM/NoPadding")')),
    ecb__cipher=(_J.format('Cipher.getInstance("AES/ECB/NoPadding")'), [2], _J.format('Cipher.getInstance("AES/GCM/NoPadding")')),
    rsa__no__padding=(_J.format('Cipher.getInstance("RSA/None/NoPadding")'), [2], _J.format('Cipher.getInstance("RSA/ECB/OAEPPadding")')),
    weak__ssl__context=(_J.format('SSLContext c = SSLContext.getInstance("TLSv1")'), [2], _J.format('SSLContext c = SSLContext.getInstance("TLSv1.3")')),
    deprecated__des=(_J.format('Cipher c = Cipher.getInstance("DESede/CBC/X")'), [2], _J.format('Cipher c = Cipher.getInstance("AES/CBC/X")')),
    custom__digests=("class D extends MessageDigest {\n}\n", [0], "class D extends Digest {\n}\n"),
    deprecated__default__httpclient=(_J.format("Object c = new DefaultHttpClient()"), [2], _J.format("Object c = new SystemDefaultHttpClient()")),
    no__null__cipher=(_J.format("run(new NullCipher(), new javax.crypto.NullCipher())"), [2, 2], _J.format("run(new Cipher())")),
    sha224__usage=(_J.format('MessageDigest.getInstance("SHA-224")'), [2], _J.format('MessageDigest.getInstance("SHA-256")')),
    unsafe_path_traversal=(_J.format('File a = new File("/srv/" + name)'), [2], _J.format('File a = new File("/srv/x")')),
)
_add(
    "javascript",
    js_alert_in_prod=("alert('x')\nwindow.alert(1)\n", [0, 1], "notify('x')\ndialog.alert(1)\n"),
    js_confirm_in_prod=("if (confirm('x')) { go() }\n", [0], "sure('x')\n"),
    js_prompt_in_prod=("let a = window.prompt('x')\n", [0], "let a = ask('x')\n"),
    js_debugger_in_prod=("function f() {\n  debugger;\n}\n", [1], "function f() {\n  // debugger\n}\n"),
    js_undefined_assignment=("let a\nb = 1\n", [0], "b = 1\n"),
    js_lazy_load_module=("function f() {\n  const m = require('m')\n}\nconst g = () => {\n  x = require('x')\n}\n", [1, 4], "const m = require('m')\n"),
    no__double__eq=("if (a == b) {}\n", [0], "if (a === b) {}\n"),
    unused__import=("import { a, b as c } from 'm'\na(1)\n", [0], "import a, { b } from 'm'\na(b)\n"),
    no_exec=("function f(x) { console.log(x) }\nconst v = user.prompt()\nf(v)\n", [2], "function f(x) { return x }\nf(1)\n"),
    sha1_detector=("import jsSHA from 'jssha'\nconst h = new jsSHA('SHA-1', 'TEXT')\n", [1], "import jsSHA from 'jssha'\nconst h = new jsSHA('SHA-256', 'TEXT')\n"),
    sql_injection=("const q = 'a ' + id\ndb.query(q)\ndb.raw(`b ${id}`)\n", [1, 2], "db.query('a ?', [id])\n"),
)
_add(
    "php",
    dangerous_eval=('<?php\neval($x);\neval("a $y b");\neval($_GET["c"]);\n', [1, 2, 3], '<?php\neval("1 + 2;");\n'),
)
_add("rust", avoid_unwrap=("fn f() {\n    let a = b().unwrap();\n}\n", [1], "fn f() {\n    let a = b().unwrap_or(1);\n}\n"))
_route = "@app.route('/a')\ndef f(a):\n    {}\n"
_req = "a = request.GET.get('a')\n{}\n"
_add(
    "python",
    app__run__with__bad__host=("app.run(debug=x, host='0.0.0.0')\n", [0], "app.run(host='127.0.0.1')\n"),
    avoid__marksafe=("mark_safe(f'<b>{x}</b>')\nmark_safe('<b>' + x)\nmark_safe('<b>{}'.format(x))\n", [0, 1, 2], "mark_safe('<b>x</b>')\n"),
    avoid__assert=("def f():\n    assert x, y\n", [1], "def f():\n    check(x)\n"),
    autoescape__off=("c = {'autoescape': False}\n", [0], "c = {'autoescape': True}\n"),
    csrf__exempt=("@csrf_exempt\ndef f(r):\n    pass\n", [0], "@login_required\ndef f(r):\n    pass\n"),
    distributed__security__required__encryption=("s = Security(tls=1, require_encryption=False)\n", [0], "s = Security(require_encryption=True)\n"),
    django__class__custom__extends=("class A(B, Func):\n    pass\n", [0], "class A(Model):\n    pass\n"),
    empty__aes__key=("c = AES.new('', AES.MODE_CFB)\n", [0], "c = AES.new('k', AES.MODE_CFB)\n"),
    filter__issafe=("@register.filter(is_safe=True)\ndef f(v):\n    return v\n", [0], "@register.filter\ndef f(v):\n    return v\n"),
    flask__avoid__direct__app__run=("app.run()\n", [0], "if __name__ == '__main__':\n    app.run()\n"),
    flask__debug__enabled=("x.go(port=1, debug=True)\n", [0], "x.go(debug=False)\n"),
    format__html__param=("format_html(text)\nformat_html(f'{a}')\nformat_html('x %s' % a)\n", [0, 1, 2], "format_html('x {}', a)\n"),
    globals__as__template__context=("render(r, 'a.html', globals())\n", [0], "render(r, 'a.html', {})\n"),
    insecure__cipher__arc4=("c = Cipher(algorithms.ARC4(k), mode=None)\n", [0], "c = Cipher(algorithms.AES(k), m)\n"),
    insecure__hash__sha1=("h = hashes.SHA1()\n", [0], "h = hashes.SHA256()\n"),
    insufficient__keysize=("dsa.generate_private_key(key_size=1024)\nrsa.generate_private_key(65537, 1024)\nec.generate_private_key(ec.SECT163K1, b)\n", [0, 1, 2], "rsa.generate_private_key(65537, 4096)\n"),
    jwt__python__none__alg=("jwt.encode(p, k, algorithm='none')\njwt.decode(t, k, algorithms=['none'])\n", [0, 1], "jwt.encode(p, k, algorithm='HS256')\n"),
    post__after__isvalid=("if form.is_valid():\n    a = request.POST['a']\n    b = request.POST.get('b')\n", [1, 2], "a = request.POST['a']\n"),
    query__set__extra=("q.extra(where=['a'])\nq.extra()\n", [0, 1], "q.extra(select={'a': 'b'})\n"),
    safe__string__extend=("class A(SafeText):\n    pass\n", [0], "class A(Text):\n    pass\n"),
    tainted__pickle__deserialize=("def handler(event, context):\n    pickle.loads(event['a'])\n", [1], "def other(event):\n    pickle.loads(event['a'])\n"),
    use__ftp__tls=("f = ftplib.FTP('h')\n", [0], "f = ftplib.FTP_TLS('h')\n"),
    weak__ssl__version=("v = ssl.PROTOCOL_SSLv3\nw = SSL.TLSv1_METHOD\n", [0, 1], "v = ssl.PROTOCOL_TLSv1_2\n"),
    os__system__injection=(_route.format("os.system('ls ' + a)"), [2], _route.format("os.system('ls')")),
    path__traversal__open=(_route.format("open(a)"), [2], _route.format("open('x')")),
    csv__writer__injection=("w = csv.writer(f)\na = request.args.get('a')\nw.writerow(a)\n", [2], "w = csv.writer(f)\nw.writerow(b)\n"),
    aws__lambda__sqli=("c = conn.cursor()\nc.execute('select ' + event['a'])\n", [1], "c = conn.cursor()\nc.execute('select 1')\n"),
    dangerous__create__exec=("create_subprocess_exec(p, event['a'])\n", [0], "create_subprocess_exec(p, 'ls')\n"),
    django__insecure__pickle__deserialize=(_req.format("pickle.loads(a)"), [1], "pickle.loads(b)\n"),
    django__missing__throttle__config=("REST_FRAMEWORK = {'A': 1}\n", [0], "REST_FRAMEWORK = {'DEFAULT_THROTTLE_RATES': {}}\n"),
    django__password__empty__string=("p = ''\nuser.set_password(p)\n", [1], "user.set_password(q)\n"),
    django__request__data__write=(_req.format("f.write(a)"), [1], "f.write(b)\n"),
    django__request__httpresponse=(_req.format("r = HttpResponse(f'x {a}')"), [1], "r = HttpResponse('x')\n"),
    django__sql__injection=("c = connection.cursor()\n" + _req.format("c.execute('select %s' % a)"), [2], "c = connection.cursor()\nc.execute('select 1')\n"),
    ssrf__injection=(_req.format("requests.get(f'http://{a}/')"), [1], "requests.get('http://x/')\n"),
    flask__format__string__return=(_route.format("return '<b>%s' % a"), [2], _route.format("return page")),
    insecure__urllib__ftp=("urllib.request.urlopen('ftp://h/a')\n".replace("'", '"'), [0], 'urllib.request.urlopen("https://h/a")\n'),
    nan__injection=(_route.format("x = float(a)"), [2], _route.format("x = int(a)")),
)
_cookie = "Rails.application.config.session_store :cookie_store, {}\n"
_add(
    "ruby",
    ruby_blowfish_weak_crypto=("c = Crypt::Blowfish.new(k)\n", [0], "c = Crypt::AES.new(k)\n"),
    ruby_dsa_weak_crypto=("k = OpenSSL::PKey::DSA.new(2048)\n", [0], "k = OpenSSL::PKey::EC.new(c)\n"),
    ruby_rsa_weak_crypto=("k = OpenSSL::PKey::RSA.new(2048)\n", [0], "k = OpenSSL::PKey::EC.new(c)\n"),
    ruby_md5_weak_hash=("d = Digest::MD5.hexdigest(s)\n", [0], "d = Digest::SHA256.hexdigest(s)\n"),
    ruby_sha1_weak_hash=("d = Digest::SHA1.hexdigest(s)\n", [0], "d = Digest::SHA256.hexdigest(s)\n"),
    ruby_ssl_no_verify=("h.verify_mode = OpenSSL::SSL::VERIFY_NONE\n", [0], "h.verify_mode = OpenSSL::SSL::VERIFY_PEER\n"),
    ruby_eval_method=("def f(x)\n  eval(x)\nend\n", [1], "def f(x)\n  evaluate(x)\nend\n"),
    ruby_force_ssl=("config.force_ssl = false\n", [0], "config.force_ssl = true\n"),
    ruby_rails_http_hardcoded_passwd=('http_basic_authenticate_with name: "u", password: "p"\n', [0], 'http_basic_authenticate_with name: "u", password: ENV["P"]\n'),
    ruby_rails_httponly_cookie=(_cookie.format("same_site: :lax, httponly: false"), [0], _cookie.format("httponly: true, same_site: :lax")),
    ruby_rails_insecure_smtp=("config.action_mailer.smtp_settings = {\n  openssl_verify_mode: 'none'\n}\n", [0], "config.action_mailer.smtp_settings = { port: 1 }\n"),
    ruby_rails_samesite_cookie=(_cookie.format("key: '_a'"), [0], _cookie.format("same_site: :lax")),
    ruby_rails_unsafe_direct_assignment=("attr_accessible :all\n", [0], "attr_accessible :name\n"),
    ruby_skip_authorization=("class A\n  skip_authorization_check only: :b\nend\n", [1], "class A\n  check_authorization\nend\n"),
)
