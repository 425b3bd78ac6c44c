"""Definitions, imports and entry points of every language, line by line."""

import pytest

from factlode.sources import languages

DEFINITIONS = {
    "a.py": {"async def run(x):": ("run", "function"), "    def _f(self):": ("_f", "function"), "class A(B):": ("A", "class"), "x = define": None, "classes = 1": None},
    "a.js": {"export async function load() {": ("load", "function"), "class Cart extends Base {": ("Cart", "class"), "const add = (a, b) => a + b": ("add", "function"), "export const go = async () => {": ("go", "function"), "const n = 3": None, "let f = () => 1": None},
    "a.ts": {"export abstract class A {": ("A", "class"), "export interface I {": ("I", "interface"), "type T = string": ("T", "type"), "enum E { A }": ("E", "enum")},
    "A.java": {"public final class Order {": ("Order", "class"), "interface Pay {": ("Pay", "interface"), "public enum Kind {": ("Kind", "enum"), "private record P(int x) {}": ("P", "record"), "  int total() {": None},
    "a.kt": {"suspend fun load(): Int {": ("load", "function"), "data class A(val x: Int)": ("A", "class"), "object Single {": ("Single", "type")},
    "a.scala": {"  def run(x: Int) = x": ("run", "function"), "sealed abstract class A": ("A", "class"), "case object B": ("B", "class"), "trait T {": ("T", "class")},
    "a.go": {"func main() {": ("main", "function"), "func (s *Server) Start(p int) error {": ("Start", "function"), "type Server struct {": ("Server", "type"), "type Id int": None},
    "a.rs": {"pub async fn run() {": ("run", "function"), "pub struct A {": ("A", "type"), "trait T {": ("T", "type"), "impl A {": None},
    "a.cs": {"public sealed class A : B {": ("A", "class"), "internal interface I": ("I", "interface"), "public enum E { A }": ("E", "type")},
    "a.rb": {"  def valid?(x)": ("valid?", "function"), "def name=(v)": ("name=", "function"), "def go": ("go", "function"), "module M": ("M", "class")},
    "a.php": {"public static function get($x) {": ("get", "function"), "final class A {": ("A", "class"), "trait T {": ("T", "class")},
    "a.c": {"static int add(int a, int b) {": ("add", "function"), "char *name(void) {": ("name", "function"), "int add(int a, int b);": None, "  if (x) {": None, "} else if (x) {": None, "main() {": None},
    "a.cpp": {"class A {": ("A", "class"), "void A::run(int x) {": ("run", "function"), "std::vector<int> all() {": ("all", "function")},
}
IMPORTS = {
    "a.js": {"import { a, b } from './b'": ["./b"], "const x = require('fs')": ["fs"], "import x": []},
    "A.java": {"import java.util.List;": ["java.util.List"], "import static a.B.c;": ["a.B.c"], "important = 1": []},
    "a.go": {'\t"net/http"': ["net/http"], '\tf "fmt"': ["fmt"], 'import "os"': ["os"], 'x := "os" + y': []},
    "a.rs": {"use std::io::Read;": ["std::io::Read"]},
    "a.cs": {"using System.Text;": ["System.Text"], "using static System.Math;": ["System.Math"]},
    "a.rb": {"require_relative 'lib/a'": ["lib/a"], 'require "json"': ["json"]},
    "a.php": {"use App\\Models\\User;": ["App\\Models\\User"], "require_once('a.php');": ["a.php"], "include 'b.php';": ["b.php"]},
    "a.c": {"#include <sys/types.h>": ["sys/types.h"], '# include "a.h"': ["a.h"]},
}
ENTRIES = {
    "a.py": {'if __name__ == "__main__":': ["main"], "def main():": ["main"], "@app.get('/x')": ["route"], "app.get(1)": []},
    "a.js": {"app.post('/x', f)": ["route"], "app.listen(3000)": ["server"], "list.get(0)": []},
    "a.ts": {"@Get('/x')": ["route"], "router.get('/x', f)": ["route"]},
    "A.java": {"public static void main(String[] a) {": ["main"], "@GetMapping(\"/x\")": ["route"]},
    "a.go": {"func main() {": ["main"]}, "a.rs": {"fn main() {": ["main"]}, "a.kt": {"fun main(a: Array<String>) {": ["main"]},
    "a.scala": {"object A extends App {": ["main"]}, "a.cs": {"static async Task Main(string[] a)": ["main"], "[HttpGet]": ["route"]},
    "a.rb": {"if __FILE__ == $0": ["main"]}, "a.c": {"int main(void) {": ["main"]},
}


@pytest.mark.parametrize("path", sorted(DEFINITIONS))
def test_definitions(path):
    lang = languages.language_of(path)
    assert {line: lang.definition(line) for line in DEFINITIONS[path]} == DEFINITIONS[path]


def test_imports_and_entries():
    assert {p: {line: languages.language_of(p).imported(line) for line in lines} for p, lines in IMPORTS.items()} == IMPORTS
    assert {p: {line: languages.language_of(p).entered(line) for line in lines} for p, lines in ENTRIES.items()} == ENTRIES


def test_every_language_is_tested():
    assert {languages.language_of(p).name for p in DEFINITIONS} == {lang.name for lang in languages.LANGUAGES}
