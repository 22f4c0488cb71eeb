"""Small sources whose facts are known, one set for each language."""

from __future__ import annotations

PYTHON = [
    (
        "pkg/app.py",
        '''"""App module."""
import os.path
import numpy as np
from .util import helper as h
from pkg.models import Base
LIMIT = 10

@dataclass
class Point(Base):
    """A point."""
    x: Coord = 0

class Dog(Base):
    @property
    def name(self) -> str:
        return self.n
    def bark(self, loud: Volume) -> None:
        self.voice = Voice()
        self.voice.play()
        if loud:
            helper()
        def nested():
            other()

def main():
    d = Dog()
    d.bark()
    h()
    return main()
''',
    ),
    ("pkg/util.py", "def helper():\n    pass\n"),
    ("pkg/broken.py", "def (:\n"),
]
TYPESCRIPT = [
    (
        "src/index.ts",
        """import React, { useState as us } from 'react';
import * as path from "path";
import './side';
import { Cat } from './animals';
export class Dog extends Animal implements Pet {
  private age = 3;
  constructor(n: string) { super(n); init(); }
  bark(): void { if (this.age > 1) { this.say(); } log.info("x"); }
}
export interface Shape extends Base, Other { area(): number; }
type Id = string | number;
enum Color { Red, Green }
export const add = (a: number) => { return sum(a); };
export default function greet(name: string) { const r = await fetchIt(name); console.log(r); }
run();
""",
    ),
    ("src/old.js", "function Old() { helper(); }\nconst f = function () { go(); };\n"),
]
RUST = [
    (
        "src/lib.rs",
        """//! crate docs
use crate::model::{Node, Edge};
use std::collections::HashMap;
pub mod model;
/// A point.
/// Second line.
pub struct Point { pub x: f64, owner: Owner, tags: Vec<Tag>, name: &'static str }
enum Kind { A, B(u8) }
trait Draw { fn draw(&self) -> Canvas; }
impl Draw for Point {
    fn draw(&self) -> Canvas { self.prepare(); Canvas::new() }
}
mod inner { pub fn go() -> Result<Node> { if ready() { step(1); } helper.run() } }
""",
    ),
]
CPP = [
    (
        "src/shape.cpp",
        """#include <vector>
#include "shape.h"
namespace geo {
class Circle : public Shape, private Base<int> {
public:
    Circle(double r);
    double area() const { return compute(r_); }
};
struct Point : Base { int x; };
template <class T> class Box { void put(T t); };
double Circle::scale(double k) { helper.grow(k); std::move(k); return area(); }
void proto(int);
}
""",
    ),
]
ALL = {"python": PYTHON, "ts": TYPESCRIPT, "rust": RUST, "cpp": CPP}
