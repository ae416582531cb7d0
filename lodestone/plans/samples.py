"""Small hand-written inputs with the results that they must give."""

from __future__ import annotations

TABLES = [
    ("two rows", "<table><tr><th>CPU</th><th>Mem</th></tr><tr><td>8 <b>cores</b></td></tr></table>", "| CPU | Mem |\n| --- | --- |\n| 8 cores |  |"),
    ("empty rows", "<table><tr><td> </td></tr></table>", ""),
    ("no table", "<p>text</p>", ""),
    ("upper case", "<TABLE><TR class='a'><TD>x</TD></TR>\n<TR><TD>\n y </TD><TD>z</TD></TR></TABLE>", "| x |  |\n| --- | --- |\n| y | z |"),
]

DEPLOYMENT = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: api
  namespace: prod
spec:
  replicas: 3
  template:
    spec:
      containers:
        - name: api
          image: api:1
          resources:
            limits: {cpu: 1}
          livenessProbe:
            httpGet: {path: /, port: 80}
"""
YAML = [
    ("deployment", DEPLOYMENT, 'Kubernetes Deployment "api" in namespace "prod". Configures: replica count, container CPU and memory requests and limits, liveness probe.'),
    ("service", "apiVersion: v1\nkind: Service\nmetadata:\n  name: web\nspec:\n  ports:\n    - port: 80\n    - port: 443\n", 'Kubernetes Service "web". Configures: type ClusterIP, 2 exposed port(s).'),
    ("autoscaler", "apiVersion: v2\nkind: HorizontalPodAutoscaler\nmetadata: {name: h}\nspec:\n  minReplicas: 1\n  maxReplicas: 4\n  metrics:\n    - resource: {name: memory}\n    - resource: {name: cpu}\n", 'Kubernetes HorizontalPodAutoscaler "h". Configures: minimum replica count, maximum replica count, autoscaling on cpu, memory metrics.'),
    ("config map", "apiVersion: v1\nkind: ConfigMap\nmetadata: {name: c}\ndata: {a: '1', b: '2'}\n", 'Kubernetes ConfigMap "c". Configures: keys: a, b.'),
    ("ingress", "apiVersion: v1\nkind: Ingress\nmetadata: {name: i}\nspec:\n  rules:\n    - host: a.example\n    - host: b.example\n", 'Kubernetes Ingress "i". Configures: hostnames a.example, b.example.'),
    ("cron job", "apiVersion: v1\nkind: CronJob\nmetadata: {name: j}\nspec: {schedule: '0 1 * * *'}\n", 'Kubernetes CronJob "j". Configures: schedule 0 1 * * *.'),
    ("compose", "services:\n  web: {image: nginx, ports: ['80:80'], depends_on: [db]}\n  db: {image: postgres, volumes: ['d:/d']}\n", "Docker Compose configuration with services: web, db. Defines port mappings, mounted volumes, service dependencies."),
    ("docker_compose:part", "version: '3'\nweb: {image: nginx, environment: {A: b}}\nx-note: {a: 1}\n", "Docker Compose configuration with services: web. Defines environment variables."),
    ("docker_compose:bare", "version: '3'\n", "Docker Compose configuration fragment."),
    ("helm_values:nested", "services:\n  api: {replicas: 1}\nglobal: {a: 1}\n", "Helm values for components: api, global."),
    ("kubernetes_manifest:unnamed", "kind: Job\nspec: {schedule: x}\n", 'Kubernetes Job "<unnamed>". Configures: schedule x.'),
    ("plain", "alpha: 1\nbeta: [1, 2]\n", "YAML configuration with top-level keys: alpha, beta."),
    ("many keys", "".join(f"k{i}: {i}\n" for i in range(17)), "YAML configuration with top-level keys: " + ", ".join(f"k{i}" for i in range(15)) + " and 2 others."),
    ("list", "- a\n- b\n", "YAML configuration fragment."),
    ("broken", 'good: 1\nbad: "x\n', "YAML configuration fragment with keys: good, bad."),
]
HCL = [
    ("resource", 'resource "aws_eks_cluster" "main" {\n  name     = "x"\n  role_arn = var.role\n  vpc_config {\n    subnet_ids = [1]\n  }\n}\n', 'Terraform resource "aws_eks_cluster". Attributes: name, role_arn, vpc_config block.'),
    ("module", 'module "net" {\n  source = "./net" # with { brace\n}\n', 'Terraform module "net". Attributes: source.'),
    ("locals", "locals {\n  a = 1\n  b = { c = 2 }\n}\n", "Terraform locals. Attributes: a, b."),
    ("empty", 'variable "x" {}\n', 'Terraform variable "x".'),
]
PUPPET = [
    ("class", "class web (\n  String $version = '1',\n  $ensure = present,\n) {\n  package { 'nginx':\n    ensure => $ensure,\n  }\n  -> file { '/etc/x':\n    ensure => file,\n  }\n}\n", "Puppet block with parameters: version, ensure; declares resources: file, package; uses dependency chain ordering."),
    ("resource", "package { 'ntp':\n  ensure => installed,\n}\n", "Puppet block with declares resources: package."),
    ("node", "node 'a.example' {\n  include web\n}\n", "Puppet block."),
]

GO = "package main\n\nimport \"fmt\"\n\ntype T struct {\n\tA int\n}\n\nfunc (t T) Name() string {\n\treturn \"}\"\n}\n\nfunc main() {\n\tfmt.Println(T{1}.Name())\n}\n"
PYTHON = "import os\n\nX = 1\n\ndef f():\n    return 1\n\n@cache\ndef g(x):\n    return x\n\nclass C:\n    def m(self):\n        pass\n"
RUBY = "require 'x'\n\nclass A\n  def b\n    if true\n      1\n    end\n  end\nend\n\ndef c\n  [1].each do |x|\n    x\n  end\nend\n"
JAVASCRIPT = "import x from 'x';\nexport function f(a) {\n  return `}${a}`;\n}\nclass K {\n  m() { return 1; }\n}\nconst y = () => {\n  return 2;\n};\n"
TYPESCRIPT = "interface I {\n  a: string;\n}\nexport type T = { b: number } | null;\nfunction f(x: I): T {\n  return null;\n}\n"
BASH = "#!/bin/bash\nset -e\nbuild() {\n  echo \"}\"\n}\nfunction deploy {\n  build\n}\ndeploy\n"
DOCKERFILE = "FROM golang AS build\nRUN go build\n\nFROM scratch\nCOPY --from=build /a /a\n"
TF_JSON = '{"resource": {"aws_eks_cluster": {"main": {"name": "x"}}}, "output": {"o": {"value": 1}}}'
CSV = "﻿id,name,note,name\n1,\"a\nb\",,last\n,,,\n2,c\n3,d,e,f,surplus\n"
HELM = "services:\n" + "".join(f"  s{i}:\n    image: registry/s{i}\n    # kept note {i}\n    env:\n" + "".join(f"      KEY_{j}: value-{i}-{j}\n" for j in range(40)) for i in range(6)) + "global:\n  domain: example.com\n"
RECORDS = '{"records": [' + ", ".join(f'{{"host": "h{i}", "role": "r{i % 3}", "note": "{"n" * 30}"}}' for i in range(60)) + "]}"
FILES = [
    ("docs/readme.md", "A guide.\n\n" + "Words that fill a page. " * 200),
    ("src/main.go", GO), ("src/app.py", PYTHON), ("src/broken.py", "def f(:\n"), ("src/a.rb", RUBY), ("src/a.js", JAVASCRIPT), ("src/a.ts", TYPESCRIPT), ("bin/run.sh", BASH), ("Dockerfile", DOCKERFILE),
    ("terraform/main.tf", "".join(x for _, x, _ in HCL)), ("terraform/eks.tf.json", TF_JSON), ("terraform/prod.tfvars", 'region = "eu"\n'),
    ("kubernetes/api.yaml", DEPLOYMENT + "---\n" + YAML[1][1]), ("helm/values.yaml", HELM), ("cmdb/hosts.json", RECORDS), ("cmdb/list.csv", CSV), ("puppet/site.pp", "".join(x for _, x, _ in PUPPET)),
]

PERMISSIONS = [
    ("f1", [("user", "a@x.io", None), ("domain", None, "x.com"), ("anyone", None, None), ("user", None, "no mail")]),
    ("f2", [("group", "g@x.io", "G"), ("domain", "d@x.io", None), ("other", "o@x.io", None)]),
    ("f3", []),
    ("f4", None),
]
PERMISSIONS_GOT = {"f1": "a@x.io,domain:x.com,anyone", "f2": "g@x.io,domain:d@x.io", "f3": "", "f4": ""}
FOLDER_NAMES = {"p1": "Ops", "p2": "Runbooks"}
PARENTS = [("f1", ["p1", "p2"]), ("f2", ["p9"]), ("f3", []), ("f4", None)]
FOLDERS_GOT = {"f1": "/Ops/Runbooks", "f2": "/p9", "f3": "/", "f4": "/"}
_APP = "application/vnd.google-apps."
LISTING = [("1", "Plan", _APP + "document"), ("2", "Sheet.v2", _APP + "spreadsheet"), ("3", "Talk", _APP + "presentation"), ("4", "Form", _APP + "form"), ("5", "a.PDF", "application/pdf"), ("6", "a.zip", "application/zip"), ("7", "Dockerfile", "text/plain"), ("8", "n.md", "text/markdown")]
LISTING_GOT = [("1", "Plan.html", "text/html"), ("2", "Sheet.csv", "text/csv"), ("3", "Talk.txt", "text/plain"), ("5", "a.PDF", "application/pdf"), ("8", "n.md", "text/markdown")]
ANSWERS = ("I could not find this information in the available documents.", "The port is 8080.", "I DON'T HAVE that.", "We were unable to locate it.", "There is no relevant information here.", "It cannot answer.", "no matching details", "Not in the provided documents.")
