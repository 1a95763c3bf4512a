"""A small web application of our own, as (relative_path, text), in the shapes the extractors are for."""

FILES = {
    "app/Http/Controllers/BookController.php": r"""<?php
namespace App\Http\Controllers;

use App\Http\Requests\SaveBookRequest;
use App\Http\Resources\BookResource;
use App\Models\Book;
use Illuminate\Support\Facades\Gate;

class BookController extends Controller
{
    public function __construct()
    {
        $this->authorizeResource(Book::class, 'book', ['only' => ['show', 'update']]);
    }

    public function index()
    {
        return BookResource::collection(Book::available()->recent()->paginate(20));
    }

    public function store(SaveBookRequest $request)
    {
        $book = Book::create($request->validated());
        return (new BookResource($book))->response()->setStatusCode(201);
    }

    public function show(Book $book)
    {
        abort_unless($book->open, 404);
        return new BookResource($book->load('author'));
    }

    public function update(Request $request, Book $book)
    {
        $data = $request->validate(['title' => 'required|string|max:80', 'tags' => ['array', Rule::in(['a', 'b'])], 'meta.year' => 'integer', 'cover' => 'image']);
        $only = $request->only(['page', 'sort']);
        return response()->json(['ok' => true, 'count' => 3, 'link' => 'https://x.test'], 202);
    }

    public function destroy(Book $book)
    {
        if (! Gate::allows('remove', $book)) { throw new AuthorizationException('no'); }
        return response()->noContent();
    }

    protected function helper() { return 1; }
}
""",
    "app/Http/Controllers/ExportController.php": r"""<?php
namespace App\Http\Controllers;
class ExportController
{
    public function __invoke() { $code = 410; abort($code); return response()->download($path, 'books.csv'); }
    public function go() { return redirect()->route('books.index'); }
}
""",
    "app/Http/Requests/SaveBookRequest.php": r"""<?php
namespace App\Http\Requests;
class SaveBookRequest extends FormRequest
{
    public function authorize() { return $this->user()->can('create', Book::class); }
    public function rules(): array
    {
        return ['title' => 'required|string', 'isbn' => ['nullable', 'unique:books'], 'authors' => 'array', 'price' => 'numeric|min:0', 'state' => 'in:new,used'];
    }
}
""",
    "app/Http/Resources/BookResource.php": r"""<?php
namespace App\Http\Resources;
use Illuminate\Http\Resources\Json\JsonResource;
class BookResource extends JsonResource
{
    public function toArray($request)
    {
        return ['id' => $this->id, 'title' => $this->title, 'price' => $this->price, 'printed_at' => $this->printed_at, 'notes' => NoteResource::collection($this->whenLoaded('notes')), 'copies' => $this->copies->count()];
    }
}
""",
    "app/Http/Resources/NoteResource.php": "<?php\nnamespace App\\Http\\Resources;\nclass NoteResource extends JsonResource {}\n",
    "app/Models/Book.php": r"""<?php
namespace App\Models;
use Illuminate\Database\Eloquent\Model;
class Book extends Model
{
    protected $fillable = ['title', 'price', 'secret'];
    protected $hidden = ['secret'];
    protected $casts = ['price' => 'decimal:2'];
    public array $translatable = ['title', self::MORE];
    const MORE = 'blurb';

    public function author() { return $this->belongsTo(Author::class); }
    public function shelves() { return $this->belongsToMany(Shelf::class)->withPivot('row', 'place')->as('spot')->withTimestamps(); }
    public function notes() { return $this->morphMany(Note::class, 'notable'); }
    public function scopeAvailable($q) { return $q; }
    public function scopeRecent($q) { return $q; }
    protected function label() { return Attribute::make(get: fn () => 1); }
}
""",
    "app/Models/Author.php": "<?php\nnamespace App\\Models;\nclass Author extends Model\n{\n    public function notes() { return $this->morphMany(Note::class, 'notable'); }\n    public function scopeRecent($q) { return $q; }\n}\n",
    "app/Models/Note.php": "<?php\nnamespace App\\Models;\nclass Note extends Model\n{\n    public function notable() { return $this->morphTo(); }\n    public function writer() { return $this->belongsTo(Author::class); }\n}\n",
    "app/Models/Shelf.php": "<?php\nnamespace App\\Models;\nclass Shelf extends Book\n{\n}\n",
    "routes/api.php": r"""<?php
use App\Http\Controllers\BookController;
use App\Http\Controllers\ExportController;
Route::apiResource('books', BookController::class);
Route::get('books/all', [BookController::class, 'index']);
Route::post('export', ExportController::class);
Route::get('go', [\App\Http\Controllers\ExportController::class, 'go']);
Route::apiResource('books', BookController::class);
""",
    "routes/channels.php": r"""<?php
Broadcast::channel('books.{id}.{kind}', function ($user, $id) { return ['}' => $id]; });
Broadcast::channel('news', function ($user) { return true; });
Broadcast::channel('lobby', function () { return []; });
Broadcast::channel('news', function ($user, $x) { return true; });
""",
    "app/Data/BaseData.php": "<?php\nnamespace App\\Data;\nuse Spatie\\LaravelData\\Data;\nclass BaseData extends Data\n{\n    public function __construct(public int $id, public ?string $note = null) {}\n}\n",
    "app/Data/OrderData.php": r"""<?php
namespace App\Data;
class OrderData extends BaseData
{
    public string|Optional $label;
    public BuyerData $buyer;
    #[DataCollectionOf(LineData::class)]
    public array $lines;
    public array $tags = [];
    public OrderData $self;
}
""",
    "app/Data/BuyerData.php": "<?php\nnamespace App\\Data;\nclass BuyerData extends BaseData\n{\n    public bool $vip;\n}\n",
    "app/Data/LineData.php": "<?php\nnamespace App\\Data;\nuse Spatie\\LaravelData\\Data;\nclass LineData extends Data\n{\n    public function __construct(public float $price, public Money|null $total) {}\n}\n",
    "app/Http/Controllers/OrderController.php": "<?php\nnamespace App\\Http\\Controllers;\nuse App\\Data\\OrderData;\nclass OrderController\n{\n    public function place(OrderData $data) { return response()->json($data); }\n}\n",
    "vendor/acme/Thing.php": "<?php\nclass Thing {}\n",
    "app/readme.txt": "no code",
}


def write(root) -> None:
    for path, text in FILES.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
