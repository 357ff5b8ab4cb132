"""A small repository in many languages. Markers and credentials are put together here, so that no scanner of this
repository finds them."""

_T, _F = "TO" + "DO", "FIX" + "ME"
SAMPLE = {
    "main.py": f"from fastapi import FastAPI\nfrom src.services.user_service import UserService\nimport models\n\napp = FastAPI()\n# {_T}(auth): check tokens\n\n\n@app.get('/users')\nasync def users():\n    return UserService().all()\n\n\n@app.route('/posts', methods=['GET', 'POST'])\ndef posts():\n    return jsonify(user)\n",
    "models.py": "class User(Base):\n    __tablename__ = 'users'\n    id = Column(Integer, primary_key=True)\n    name = Column(String)\n    password = Column(String)\n    posts = relationship('Post')\n\n\nclass Post(Base):\n    id = Column(Integer, primary_key=True)\n    user_id = Column(Integer, ForeignKey('users.id'))\n    tags: Mapped[list['Tag']] = relationship()\n",
    "src/__init__.py": "",
    "src/services/user_service.py": f"from ..util.text import clean\n\n\nclass UserService:\n    def all(self):\n        # {_F}: slow\n        return clean(self.db)\n",
    "src/services/__init__.py": "",
    "src/util/text.py": "def clean(x):\n    return x\n",
    "app/secrets.py": "key = \"" + "AKIA" + "ABCDEFGHIJKLMNOP" + "\"\npassword = \"hunter2 and more\"\nhost = '10.20.30.40'\n# password = \"in a comment\"\ntoken = os.getenv('TOKEN')\n",
    ".env": "DB_PASSWORD=s3cretvalue9\n",
    "web/server.js": "const express = require('express');\nconst u = require('./user.model');\napp.get('/api/users', list); app.post('/api/users', add);\n",
    "web/user.model.js": "const userSchema = new Schema({\n  name: { type: String },\n  posts: [{ type: Schema.Types.ObjectId, ref: 'Post' }],\n});\n",
    "web/package.json": '{"dependencies": {"express": "1", "mongoose": "7"}}',
    "web/user.entity.ts": "@Entity()\nexport class User {\n  @PrimaryGeneratedColumn()\n  id: number;\n\n  @OneToMany(() => Post, (p) => p.user)\n  posts: Post[];\n}\n",
    "web/app/(shop)/cart/page.tsx": "export default function Page() {}\n",
    "web/nest.controller.ts": "@Controller('cats')\nexport class CatsController {\n  @Get('all')\n  all(): string { return ''; }\n}\n",
    "db/schema.sql": "-- tables\nCREATE TABLE orders (\n  id INT PRIMARY KEY,\n  total DECIMAL(10, 2),\n  user_id INT,\n  FOREIGN KEY (user_id) REFERENCES users(id)\n);\n",
    "prisma/schema.prisma": "model Author {\n  id Int @id\n  email String\n  books Book[]\n}\n\nmodel Book {\n  id Int @id\n  author Author\n}\n",
    "Models/Blog.cs": "namespace Shop.Models;\n\npublic class Blog : Entity\n{\n    [Key]\n    public int Id { get; set; }\n    public string Title { get; set; }\n    public ICollection<Entry> Entries { get; set; }\n    public void Publish(int when) { }\n}\n",
    "java/Dog.java": "package a;\n\n@Entity\npublic class Dog extends Animal implements Pet {\n    @Id\n    private Long id;\n    private String name;\n    @ManyToOne\n    private Owner owner;\n\n    public String bark(int times) {\n        return name;\n    }\n}\n",
    "php/User.php": "<?php\nclass Account extends Model\n{\n    protected $fillable = ['name', 'email'];\n    public function posts() {\n        return $this->hasMany(Post::class);\n    }\n}\n",
    "go/user.go": "package user\n\ntype UserStore struct {\n\tdb DB\n\tcache *Cache\n}\n\ntype Repo interface {\n\tFind(id int) User\n}\n\nfunc (s *UserStore) GetUser(id int) (User, error) {\n\treturn s.db.Get(id)\n}\n",
    "rust/order.rs": "pub struct Order {\n    pub id: u64,\n    total: f64,\n}\n\npub enum Status {\n    Pending,\n    Paid(u32),\n}\n\nimpl Order {\n    pub fn pay(&mut self, by: u32) -> bool {\n        true\n    }\n}\n\npub trait Payable {\n    fn due(&self) -> f64;\n}\n",
    "docker-compose.yml": "services:\n  web:\n    build: .\n    depends_on: [db, cache]\n  db:\n    image: postgres:16\n  cache:\n    image: redis\n  proxy:\n    image: nginx\n    links: ['web:app']\n",
    "note.ipynb": '{"cells": [{"cell_type": "code", "source": ["df = read_csv(\'in.csv\')\\n", "df.to_parquet(\'out.parquet\')"]}, {"cell_type": "markdown", "source": "x"}]}',
    ".project/requirements/US-001.json": '{"story": {"id": "US-001", "title": "Log in", "role": "user", "want": "in", "benefit": "work", "status": "done"}, "business_rules": [{"id": "BR01", "description": "x"}], "acceptance_criteria": [{"id": "AC01", "given": "a", "when": "b", "then": "c"}], "open_questions": ["why"]}',
    ".project/requirements/HU02.md": "# HU02 [IN_PROGRESS] - Pay\n\n- **Role**: buyer\n- **Want**: to pay\n\n## Business Rules\n\n- one\n- BR-9: two\n\n## Acceptance Criteria\n\n- Given a cart, When I pay, Then it ships\n",
    ".project/product/p1.md": "---\nid: PRD-1\ntitle: Shop\nstatus: APPROVED\nowner: x\napplies_to: [src, ../out]\nrequirement_ids:\n  - US-001\n  - US-404\n---\n# Shop\n\n## Problem\n\nSlow.\n\n## Goals\n\nTBD\n\n## Open Questions\n\n- when\n",
    ".project/product/p2.md": "---\nid: prd-1\ntitle: Again\nstatus: nowhere\n---\n## Problem\n\nx\n",
    "README.md": "# Sample\n",
    "tests/test_x.py": f"# {_T}: more\n",
}
